"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of its consecutive words. Every passage is described by
how it is written (lengths, case, digits, signs, repetition) and by a signed hash of its
words, and encoded by one dense layer; gated attention, learnt from document labels alone,
weighs the passages, and the weighted sum is classified. Training is plain numpy on a
bounded sample of labelled rows; scoring reads every passage of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, lean, slices, word_codes

PASSAGE_WORDS = 64
HASH_DIMS = 16
HIDDEN = 24
ATTENTION = 16
MAX_TRAINING_DOCS = 6_000

_CLASSES = np.zeros((256, 6), np.float32)  # of bytes: upper, lower, digit, comma or full stop, other sign, non-ASCII
_CLASSES[0x41:0x5B, 0] = _CLASSES[0x61:0x7B, 1] = _CLASSES[0x30:0x3A, 2] = _CLASSES[0x80:, 5] = 1
_CLASSES[0x21:0x7F, 4] = 1 - _CLASSES[0x21:0x7F, :3].sum(axis=1)
_CLASSES[[0x2C, 0x2E], 3], _CLASSES[[0x2C, 0x2E], 4] = 1, 0
N_WORD = 9 + HASH_DIMS
N_FEATURES = N_WORD + 5


def _word_features(words: list[bytes]) -> np.ndarray:
    """A row for each distinct word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.cumsum(size) - size
    out = np.zeros((len(words), N_WORD), np.float32)
    counts = np.add.reduceat(_CLASSES[data], at, axis=0)
    out[:, :6] = counts / size[:, None]
    out[:, 6] = np.log1p(size)
    out[:, 7] = (counts[:, :2].sum(axis=1) + counts[:, 5]) == 0  # no letter
    out[:, 8] = _CLASSES[data[at + size - 1], 4]  # ends in an odd sign
    lower = (data | np.where((data >= 0x41) & (data <= 0x5A), 0x20, 0).astype(np.uint8)).astype(np.uint64)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)
    h = np.add.reduceat((lower + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)), at)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    out[:, 9:] = 1 - 2 * ((h[:, None] >> np.arange(HASH_DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text plus the end). A text without words is one passage of zeros."""
    codes, first, words = word_codes(texts, lower=False)
    n_words = np.diff(first)
    n = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    upto = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((upto[-1], N_FEATURES), np.float32)
    if not len(codes):
        return out, upto
    doc = np.repeat(np.arange(len(n)), n)
    start = first[doc] + (np.arange(upto[-1]) - upto[doc]) * PASSAGE_WORDS
    full = n_words[doc] > 0
    start = start[full]
    size = np.diff(np.append(start, len(codes)))
    by_word = _word_features(words)
    rows = np.empty((len(start), N_FEATURES), np.float32)
    for a in range(0, len(start), 4096):  # so that the rows of all words never stand at once
        b = min(a + 4096, len(start))
        lo, hi = start[a], start[b - 1] + size[b - 1]
        rows[a:b, :N_WORD] = np.add.reduceat(by_word[codes[lo:hi]], start[a:b] - lo, axis=0) / size[a:b, None]
    passage = np.repeat(np.arange(len(start)), size)
    order = np.sort(passage * np.int64(len(words)) + codes)
    fresh = np.concatenate([[True], order[1:] != order[:-1]])
    where = np.flatnonzero(fresh)
    run = np.diff(np.append(where, len(order)))
    owner = order[where] // len(words)
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])])
    rows[:, N_WORD] = np.diff(np.append(heads, len(owner))) / size  # distinct share
    rows[:, N_WORD + 1] = np.maximum.reduceat(run, heads) / size  # share of the most frequent word
    rows[:, N_WORD + 2] = np.add.reduceat(again.astype(np.float32), start) / size
    rows[:, N_WORD + 3] = size / PASSAGE_WORDS
    rows[:, N_WORD + 4] = np.log1p(size)
    out[full] = rows
    return out, upto


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionModel:
    """Dense encoder, gated attention and a logistic output; parameters in a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, n_features: int, seed: int = 42) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls({"mean": np.zeros(n_features), "scale": np.ones(n_features), "W": draw(n_features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        heads = first[:-1]
        doc = np.repeat(np.arange(len(heads)), np.diff(first))
        z = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, heads)[doc])
        a = e / np.add.reduceat(e, heads)[doc]
        bag = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "bag": bag, "doc": doc, "score": _sigmoid(bag @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        doc, heads = f["doc"], first[:-1]
        g = (f["score"] - y) * weight / weight.sum()
        d_bag = g[:, None] * p["c"]
        per = (f["h"] * d_bag[doc]).sum(axis=1)
        d_s = f["a"] * (per - np.add.reduceat(f["a"] * per, heads)[doc])
        d_vu = d_s[:, None] * p["w"]
        d_v, d_u = d_vu * f["u"] * (1 - f["v"] ** 2), d_vu * f["v"] * f["u"] * (1 - f["u"])
        d_h = f["a"][:, None] * d_bag[doc] + d_v @ p["V"].T + d_u @ p["U"].T
        d_z = d_h * (1 - f["h"] ** 2)
        return {"c": f["bag"].T @ g, "d": np.array([g.sum()]), "w": (f["v"] * f["u"]).T @ d_s, "V": f["h"].T @ d_v, "U": f["h"].T @ d_u, "W": f["z"].T @ d_z, "b": d_z.sum(axis=0)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 42) -> AttentionModel:
        """Adam over shuffled batches of documents; both classes weigh alike. One class alone gives its constant."""
        self.p["mean"], self.p["scale"] = x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64) + 1e-3
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at : at + batch]
                n = first[docs + 1] - first[docs]
                upto = np.concatenate([[0], np.cumsum(n)])
                rows = np.repeat(first[docs] - upto[:-1], n) + np.arange(upto[-1])
                t += 1
                for k, g in self.gradient(x[rows], upto, y[docs], weight[docs]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAINING_DOCS, fold=None) -> AttentionModel | None:
    """Fit on at most max_docs labelled rows, the first by a hash of their ids; fold is a condition on the id that they meet.

    Labels other than 0 and 1 are left out; an id with several labels counts by its largest. Passage features of the sample
    come to the driver. None if there are no such rows.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    if fold is not None:
        known = known.where(fold(F.col("_id")))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    # the sample has at most max_docs rows of two numbers, which bounds the broadcast
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").select(F.xxhash64("_id").alias("k"), F.col("_id").cast("bigint"), "_y", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, first = passages(batch.column("text"))
            bags = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("_id"), batch.column("_y"), pa.array(bags, pa.binary())], ["k", "_id", "_y", "x"])

    rows = sorted(bounded(chosen).mapInArrow(run, "k bigint, _id bigint, _y int, x binary").collect(), key=lambda r: (r["k"], r["_id"], bytes(r["x"])))
    if not rows:
        return None
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    y = np.array([r["_y"] for r in rows], np.float64)
    return AttentionModel.fresh(N_FEATURES).fit(np.concatenate(bags), first, y)


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (the id alone by default) and quality_score in 0..1 of every row's whole text; 0.5 everywhere without a model.

    Null texts count as empty. Every row is scored once, in its own right; an empty table gives an empty table.
    """
    keep = [id_col] if keep is None else keep
    params = None if model is None else model.p

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keep) if text_at is None else text_at
        for batch in slices(batches, at):
            if params is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = AttentionModel(params).forward(*passages(batch.column(at)))["score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(s, pa.float64())], [*keep, "quality_score"])

    kept = docs.select(*keep)
    text_at = keep.index(text_col) if text_col in keep and dict(kept.dtypes)[text_col] == "string" else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", quality_score double"
    sent = kept if text_at is not None else docs.select(*keep, F.col(text_col).cast("string").alias("_score_text"))
    return bounded(sent).mapInArrow(run, schema)


def crc_fold(col, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


