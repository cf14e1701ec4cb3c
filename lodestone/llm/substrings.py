"""Exact substring dedup over words with fixed-block anchors.

Any run of WINDOW words holds a whole aligned block of WINDOW // 2 words of each document
it stands in. So: every document's non-overlapping aligned blocks are indexed, every
rolling window of a block's length probes the index, and hits are extended to the windows
of WINDOW words that hold them, whose hashes then decide exactly, for every document at
once, which words also start in an earlier document. Consecutive windows make up the
maximal repeats.

Documents travel in batches of a few MB, compressed. A batch asks each question once per
distinct hash, so a passage that a third of all documents share costs one entry a batch,
and answers come back to batches: no pairs of documents are ever formed. Questions are
dealt by hash ranges, whose number follows the size of the text, as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodestone.llm.common import BATCH_BYTES, bounded, lean, materialize, slices, word_codes

WINDOW = 50
RANGE_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ASK = "p int, batch_id bigint, asked binary"
ANSWER = "batch_id bigint, answer binary"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as bytes: all lowest bytes, then the next, compressed."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
        parts += [a.itemsize.to_bytes(1, "little"), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _expand(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        size, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        planes = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n))
        at += size * n
    return out


def _pack_batch(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


class Batch:
    """Words of a batch of documents, and the hashes of its windows."""

    def __init__(self, blob: bytes):
        self.rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()
        self.ids = self.rows.column("id")
        self.codes, self.first, self.words = word_codes(self.rows.column("text"), lower=False)
        self.hashes = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        n = len(self.codes)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.id_of = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.in_doc = np.arange(n) - self.first[self.doc]
        self.room = np.where(known[self.doc], self.first[self.doc + 1] - np.arange(n), 0)  # words from here; null ids take no part
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)])) if n else np.ones(1, np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE_INVERSE)])) if n else np.ones(1, np.uint64)
        self.inverse = inverse
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes[self.codes] * power[:n])]) if n else np.zeros(1, np.uint64)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of length consecutive words inside one document."""
        at = np.flatnonzero(self.room >= length)
        h = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return at, h ^ (h >> np.uint64(31))


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _dealt(batch_id: int, h: np.ndarray, ranges: int, columns) -> pa.RecordBatch:
    """h is ascending, so each range of hashes is a slice."""
    p = _range(h, ranges)
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(h) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(h))
    blobs = [_squeeze(*columns(a, b)) for a, b in zip(cuts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(p[cuts].astype(np.int32)), pa.array(np.full(len(cuts), batch_id)), pa.array(blobs, pa.binary())], ["p", "batch_id", "asked"])


def _deltas(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=h[:1] * 0)


def batched(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(batch_id, blob): documents of one input partition, a few MB of text at a time; columns id, text, c0, c1, ... for carry."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH_BYTES):
            blob = _pack_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([blob], pa.binary())], ["batch_id", "blob"])
            seq += 1

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    return materialize(bounded(picked).mapInArrow(run, "batch_id bigint, blob binary"), "batches")


def _probe(batches: DataFrame, block: int, ranges: int) -> DataFrame:
    """Every batch's distinct rolling hashes, each with whether it stands aligned and whether it stands more than once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in rows for r in batch.to_pylist()):
            b = Batch(row["blob"])
            at, h = b.windows(block)
            aligned = b.in_doc[at] % block == 0
            order = np.argsort(h)
            h, aligned = h[order], aligned[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            if not len(heads):
                continue
            indexed = np.logical_or.reduceat(aligned, heads)
            several = np.diff(np.append(heads, len(h))) > 1
            h = h[heads]
            # within a range of hashes, 32 bits of the rest are enough: a chance hit only asks one question more
            yield _dealt(row["batch_id"], h, ranges, lambda i, j: (_deltas(_tail(h[i:j], ranges)), np.packbits(indexed[i:j]), np.packbits(several[i:j])))

    return batches.mapInArrow(run, ASK)


def _tail(h: np.ndarray, ranges: int) -> np.ndarray:
    """The 32 bits of each hash that follow its range number."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32))).astype(np.uint32)


def _hit(table: pa.Table, ranges: int) -> pa.Table:
    """Answers of one range: to each batch, its hashes that stand at least twice and once aligned."""
    p = table.column("p")[0].as_py()
    owners, tails, indexed, several = [], [], [], []
    for k, blob in enumerate(table.column("asked").to_pylist()):
        d, i, s = _expand(blob)
        tails.append(np.cumsum(d, dtype=np.uint32))
        indexed.append(np.unpackbits(i, count=len(d)).astype(bool))
        several.append(np.unpackbits(s, count=len(d)).astype(bool))
        owners.append(np.full(len(d), k, np.int32))
    owner, tail, indexed, several = map(np.concatenate, (owners, tails, indexed, several))
    order = np.argsort(tail, kind="stable")
    owner, tail = owner[order], tail[order]
    heads = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
    size = np.diff(np.append(heads, len(tail)))
    hot = np.logical_or.reduceat(indexed[order], heads) & ((size > 1) | np.logical_or.reduceat(several[order], heads))
    keep = np.repeat(hot, size)
    return _answers(table, owner[keep], lambda at: (np.full(1, p, np.uint32), tail[keep][at]))


def _answers(table: pa.Table, owner: np.ndarray, columns) -> pa.Table:
    ids = table.column("batch_id").to_numpy()
    order = np.argsort(owner, kind="stable")
    owned = owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], owned[1:] != owned[:-1]])) if len(owned) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(owned))
    blobs = [_squeeze(*columns(order[a:b])) for a, b in zip(cuts.tolist(), ends.tolist())]
    return pa.table({"batch_id": pa.array(ids[owned[cuts]], pa.int64()), "answer": pa.array(blobs, pa.binary())})


def _extend(batch_id: int, b: Batch, answers: list[bytes], block: int, window: int, ranges: int) -> pa.RecordBatch | None:
    """Questions about every window that holds a hit: per distinct hash, the smallest id in the batch."""
    at, h = b.windows(block)
    found = [_expand(a) for a in answers]
    wanted = np.sort(np.concatenate([(a[0].astype(np.uint64) << np.uint64(32)) | a[1] for a in found]))
    key = (_range(h, ranges) << np.uint64(32)) | _tail(h, ranges)
    hits = at[_isin(key, wanted)]
    # windows from hit - (window - block) to hit
    near = np.zeros(len(b.codes) + 1, np.int64)
    np.add.at(near, np.maximum(hits - (window - block), b.first[b.doc[hits]]), 1)
    np.add.at(near, hits + 1, -1)
    at, h = b.windows(window)
    chosen = np.cumsum(near)[at] > 0
    at, h = at[chosen], h[chosen]
    if not len(h):
        return None
    ids = b.id_of[b.doc[at]]
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    h, ids = h[heads], ids[heads].view(np.uint64)
    return _dealt(batch_id, h, ranges, lambda i, j: (h[i:j], ids[i:j]))


def _isin(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _least(table: pa.Table) -> pa.Table:
    """Answers of one range: to each batch, its hashes that an earlier document of another batch holds, with that id."""
    owners, hashes, ids = [], [], []
    for k, blob in enumerate(table.column("asked").to_pylist()):
        h, i = _expand(blob)
        hashes.append(h)
        ids.append(i.view(np.int64))
        owners.append(np.full(len(h), k, np.int32))
    owner, h, i = map(np.concatenate, (owners, hashes, ids))
    order = np.lexsort((i, h))
    owner, h, i = owner[order], h[order], i[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    first = np.repeat(i[heads], np.diff(np.append(heads, len(h))))
    # every batch but the first may hold later documents with the hash; one whose own smallest id is the smallest knows
    keep = first < i
    owner, h, first = owner[keep], h[keep], first[keep]
    return _answers(table, owner, lambda at: (h[at], first[at].view(np.uint64)))


def _removed(b: Batch, answers: list[bytes], window: int) -> np.ndarray:
    """Whether each word goes: covered by a window that also starts in a document with a smaller id."""
    at, h = b.windows(window)
    cover = np.zeros(len(b.codes) + 1, np.int64)
    if len(at):
        ids = b.id_of[b.doc[at]]
        order = np.lexsort((ids, h))
        hs = h[order]
        heads = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        size = np.diff(np.append(heads, len(hs)))
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(ids[order][heads], size)
        if answers:
            pairs = [_expand(a) for a in answers]
            asked = np.concatenate([a[0] for a in pairs])
            first = np.concatenate([a[1] for a in pairs]).view(np.int64)
            order = np.argsort(asked)
            asked, first = asked[order], first[order]
            spot = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
            least = np.where(asked[spot] == h, np.minimum(least, first[spot]), least)
        gone = at[least < ids]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
    return np.cumsum(cover)[:-1] > 0


def _with_answers(batches: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(batch_id, blob, answers) for each batch with all its answers."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got = right.column("answer").to_pylist()
        return pa.Table.from_batches([run(row["batch_id"], row["blob"], got).cast(target) for row in left.to_pylist()], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return batches.groupBy("batch_id").cogroup(answers.groupBy("batch_id")).applyInArrow(both, schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with carry, its columns instead of doc_id, the text column
    among them holding the kept words joined by one blank where words were removed and the text as it was elsewhere.

    A word goes if a window of consecutive words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Null and empty texts have no words. A row with a null id loses nothing and is no source. Rows that
    repeat an id are documents of the same id: neither is earlier than the other. Columns not in carry are not read.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    beside = [c for c in carry or [] if c != text_col]
    batches = batched(docs, id_col, text_col, beside)
    hits = _probe(batches, block, ranges).groupBy("p").applyInArrow(lambda t: _hit(t, ranges), ANSWER)
    hits = materialize(hits, "hits")

    def extend(batch_id: int, blob: bytes, answers: list[bytes]) -> pa.RecordBatch:
        none = pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["p", "batch_id", "asked"])
        return (_extend(batch_id, Batch(blob), answers, block, window, ranges) or none) if answers else none

    least = _with_answers(batches, hits, extend, ASK).groupBy("p").applyInArrow(_least, ANSWER)
    least = materialize(least, "least")
    kinds = dict(docs.select(*beside).dtypes) if beside else {}
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string" + "".join(f", c{k} {kinds[c]}" for k, c in enumerate(beside))
    with_text = carry is not None

    def finish(batch_id: int, blob: bytes, answers: list[bytes]) -> pa.RecordBatch:
        b = Batch(blob)
        gone = _removed(b, answers, window)
        words = b.words
        stay = np.flatnonzero(~gone)
        bounds = np.searchsorted(stay, b.first).tolist()
        kept_codes = b.codes[stay].tolist()
        kept = [b" ".join([words[c] for c in kept_codes[i:j]]) for i, j in zip(bounds, bounds[1:])]
        n = np.diff(b.first)
        n_removed = n - np.diff(bounds)
        changed = n_removed > 0
        texts = pc.if_else(pa.array(changed), pa.array([k.decode() if c else None for k, c in zip(kept, changed.tolist())], pa.string()), b.rows.column("text").cast(pa.string())) if with_text else pa.nulls(len(kept), pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *(f"c{k}" for k in range(len(beside)))]
        return pa.RecordBatch.from_arrays([b.ids, pa.array(n), pa.array(n_removed), pa.array([sha256(k).hexdigest() for k in kept], pa.string()), texts, *(b.rows.column(f"c{k}") for k in range(len(beside)))], names)

    out = _with_answers(batches, least, finish, schema)
    found = [F.col(c) for c in ("n_words", "n_removed", "kept_sha256")]
    if carry is None:
        return out.select("doc_id", *found)
    place = {c: F.col(f"c{k}").alias(c) for k, c in enumerate(beside)} | {text_col: F.col("kept").alias(text_col)}
    return out.select(*(place[c] for c in carry), *(f.alias(c) for f, c in zip(found, ("dedup_words", "dedup_removed", "dedup_sha256"))))
