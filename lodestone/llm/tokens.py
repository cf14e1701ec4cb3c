"""Encoding whole texts with a public tokenizer, each distinct piece of text once.

Text is cut where no token of the vocabulary's pre-tokenizer can reach across, pieces are
dictionary-encoded by Arrow, only pieces not met before go through the tokenizer, and ids
are laid out again by index arithmetic. The result equals encode(text) of each text.

Strings of the vocabulary's special tokens, such as <|endoftext|>, are taken as the tokenizer
file takes them when loaded: as their ids. With special_as_text they are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 350_000

_SOLID = np.zeros(256, bool)  # bytes that start a character which is surely no white space
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xE4:0xF5] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_POINT = np.zeros(256, bool)  # ASCII that is neither letter, digit, white space nor control
_POINT[0x21:0x7F] = True
_POINT &= ~_LETTER & ~_DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Pieces that are one word of Latin letters, which the pre-tokenizers keep whole.
_PLAIN_BLANKS = re.compile(b" ?[A-Za-z]+")
_PLAIN_WORDS = re.compile(b"[a-z]+[ \\n]*")
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _cuts(data: np.ndarray, starts: np.ndarray, by: str) -> np.ndarray:
    """First bytes of pieces that no pre-token crosses.

    blanks: before a blank that joins the word after it, and around line ends. words: after white space.
    Both: between an ASCII letter and ASCII punctuation.
    """
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        before, cut = mark[:-2], mark[1:-1]
        cut |= _LETTER[a] & _POINT[b]
        if by == "words":
            cut |= _SPACE[a] & ~_SPACE[b]
        else:
            solid = _SOLID[b]
            solid[starts[(starts > 0) & (starts < len(data))] - 1] = False  # the next character is another text's
            last = (a == 10) & solid  # the last of a run of white space stands alone before a solid character
            cut |= last
            before |= last | ((a == 32) & solid)
            cut |= (b == 10) & (a > 0x20) & (a < 0x7F)
    mark[starts] = True
    mark[len(data)] = False
    return np.flatnonzero(mark)


class PieceEncoder:
    """Encodes batches of texts; by="blanks" for byte-level BPE, by="words" for vocabularies that drop white space and case."""

    def __init__(self, path: str, by: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else self.tokenizer.get_added_tokens_decoder().items()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for _, t in added):
            raise ValueError(f"{path}: special tokens that reach into the text around them are not supported")
        self.markers = {t.content: i for i, t in added}
        self.marker = re.compile("|".join(map(re.escape, sorted(self.markers, key=len, reverse=True)))) if self.markers else None
        self.by = by
        self.known: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        """Single words go to the library's BPE model at once; all else through its whole pipeline."""
        tokenize, known, other, words = self.tokenizer.model.tokenize, self.known, [], self.by == "words"
        plain = _PLAIN_WORDS if words else _PLAIN_BLANKS
        for piece in pieces:
            if plain.fullmatch(piece):
                letters = piece.decode().rstrip() if words else piece.decode().replace(" ", _LETTERS[32])
            else:
                text = piece.decode()
                word = text.rstrip(" \n") if words else text[1:] if text[:1] == " " else text
                if not _WORD.fullmatch(word):
                    other.append(piece)
                    continue
                letters = (word.lower().encode() if words else piece).decode("latin-1").translate(_LETTERS)
            known[piece] = array("i", [t.id for t in tokenize(letters)]).tobytes()
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for piece, found in zip(part, self.tokenizer.encode_batch([p.decode() for p in part], add_special_tokens=False)):
                known[piece] = array("i", found.ids).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            if len(self.known) + len(missing) > CACHED_PIECES:
                self.known = {}
            self._learn([pieces[i] for i in missing])
            for i in missing:
                found[i] = self.known[pieces[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text plus the end); null texts count as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.marker is not None:
            holds = np.zeros(len(texts), bool)
            for m in self.markers:
                holds |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
            if holds.any():
                return self._encode_marked(texts, holds)
        return self._encode_plain(texts)

    def _encode_marked(self, texts: pa.Array, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(): texts are cut at special tokens, whose neighbours the library encodes apart."""
        parts, owner, marks = [], [], []
        for i, has in enumerate(holds.tolist()):
            if not has:
                parts.append(texts[i].as_py())
                owner.append(i)
                marks.append(-1)
                continue
            text, at = texts[i].as_py(), 0
            for m in self.marker.finditer(text):
                parts.append(text[at : m.start()])
                owner.append(i)
                marks.append(self.markers[m.group()])
                at = m.end()
            parts.append(text[at:])
            owner.append(i)
            marks.append(-1)
        ids, first = self._encode_plain(pa.array(parts, pa.large_string()))
        marks = np.array(marks)
        marked = np.flatnonzero(marks >= 0)
        ids = np.insert(ids, first[1:][marked], marks[marked].astype(ids.dtype))
        upto = first + np.concatenate([[0], np.cumsum(marks >= 0)])
        heads = np.searchsorted(np.array(owner), np.arange(len(texts) + 1))
        return ids, upto[heads]

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if self.by == "words":
            data = _LOWER[data]
        cuts = _cuts(data, offsets[:-1], self.by) if len(data) else np.zeros(0, np.int64)
        bounds = np.append(cuts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        first = np.searchsorted(cuts, offsets)
        coded = pieces.dictionary_encode()
        found = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(found), np.int32))
        taken = lists.take(coded.indices)
        ids = taken.flatten().to_numpy(zero_copy_only=False)
        upto = np.asarray(taken.offsets) if len(taken) else np.zeros(1, np.int64)
        return ids, (upto - upto[0])[first]


_ENCODERS: dict[tuple[str, str, bool], PieceEncoder] = {}


def encoder(path: str, by: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    key = (path, by, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to every text's ids."""
    out = np.insert(ids, first[1:], end_id)
    return out, first + np.arange(len(first))
