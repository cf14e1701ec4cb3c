"""Log-bilinear language model trained with noise-contrastive estimation.

Every word belongs to a unit: the most frequent words are units of their own, other words
share units by their last two letters, and the end of a text is a unit. The score of unit
u after unit c is r_c . q_u + b_u; it is trained in numpy with the noise-contrastive
objective in expectation, positive and noise terms both as matrix products over the table
of unit pairs counted in all training text, and normalised by one batched matrix product
over all contexts. Within a shared unit a seen word has its discounted share of the unit's
count, and what the discount frees is the probability of a word not seen in training, which
is one outcome per unit. Probabilities of a context's outcomes add up to one.

Counts cover every training document. Words travel as 64-bit hashes; counts of the most
frequent words, at most COMMON_WORDS of them, are broadcast, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodestone.llm.common import bounded, lean, materialize, slices, word_codes
from lodestone.llm.quality import crc_fold

OWN_UNITS = 767
SHARED_UNITS = 256
END = OWN_UNITS + SHARED_UNITS
UNITS = END + 1
COMMON_WORDS = 1 << 18
DIMS = 24
NOISE = 8.0
DISCOUNT = 0.75
FLUSH_WORDS = 1 << 18


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _shared_unit(words: list[bytes]) -> np.ndarray:
    """The shared unit of each word, by its last two letters with closing signs left out."""
    tails = [w.rstrip(b".,;:!?")[-3:] or w[-3:] for w in words]
    return OWN_UNITS + _hashes(tails).view(np.uint64).astype(np.uint64) % np.uint64(SHARED_UNITS)


def _units(words: list[bytes], hashes: np.ndarray, own: np.ndarray, unit_of_own: np.ndarray) -> np.ndarray:
    unit = _shared_unit(words).astype(np.int64)
    if len(own):
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        unit = np.where(own[at] == hashes, unit_of_own[at], unit)
    return unit


def _with_ends(codes: np.ndarray, first: np.ndarray, end_code: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(codes, first[1:], end_code), first + np.arange(len(first))


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, unit, n): occurrences of every word in all texts, summed up by each task before the shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, u, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(h)
            h, u, n = h[order], u[order], n[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            return h[heads], u[heads], np.add.reduceat(n, heads) if len(h) else n

        def out() -> pa.RecordBatch:
            h, u, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(u.astype(np.int32)), pa.array(n)], ["hash", "unit", "n"])

        for batch in slices(batches, "text"):
            codes, _, words = word_codes(batch.column("text"), lower=True)
            n = np.bincount(codes, minlength=len(words))
            seen = n > 0
            words = [w for w, s in zip(words, seen.tolist()) if s]
            held.append((_hashes(words), _shared_unit(words).astype(np.int64), n[seen].astype(np.int64)))
            if sum(len(x[0]) for x in held) > 4 * FLUSH_WORDS:
                held[:] = [merged()]
                if len(held[0][0]) > 2 * FLUSH_WORDS:
                    yield out()
        if held:
            yield out()

    return bounded(texts.select("text")).mapInArrow(run, "hash bigint, unit int, n bigint").groupBy("hash", "unit").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, own: np.ndarray, unit_of_own: np.ndarray) -> DataFrame:
    """(cell, n): how often unit cell % UNITS follows unit cell // UNITS. At most UNITS squared rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in slices(batches, "text"):
            codes, first, words = word_codes(batch.column("text"), lower=True)
            unit = np.append(_units(words, _hashes(words), own, unit_of_own), END)
            codes, first = _with_ends(codes, first, len(words))
            after = unit[codes]
            before = np.concatenate([[END], after[:-1]])  # a text starts after the end of another
            total += np.bincount(before * UNITS + after, minlength=len(total))
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    return bounded(texts.select("text")).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def train_nce(pairs: np.ndarray, dims: int = DIMS, noise: float = NOISE, steps: int = 120, rate: float = 0.05, seed: int = 42) -> dict[str, np.ndarray]:
    """R, Q, b of the model from a table of pair counts. Contexts weigh by the root of their counts, so that rare ones are learnt too."""
    n = len(pairs)
    rng = np.random.default_rng(seed)
    of_context = pairs.sum(axis=1)
    unigram = pairs.sum(axis=0) + 1.0
    unigram /= unigram.sum()
    log_noise = np.log(noise * unigram).astype(np.float32)
    weight = np.sqrt(of_context)
    weight /= max(weight.sum(), 1e-12)
    share = (pairs / np.maximum(of_context, 1)[:, None]).astype(np.float32)
    p = {"R": rng.normal(0, 0.1, (n, dims)).astype(np.float32), "Q": rng.normal(0, 0.1, (n, dims)).astype(np.float32), "b": np.log(unigram).astype(np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    w = weight.astype(np.float32)[:, None] * n
    for t in range(1, steps + 1):
        score = p["R"] @ p["Q"].T + p["b"]
        data = 0.5 * (1 + np.tanh(0.5 * (score - log_noise)))  # P(the pair is data, not noise)
        d = w * (share * (1 - data) - (noise * unigram.astype(np.float32)) * data)  # ascent direction of the expected objective
        for k, g in {"R": d @ p["Q"], "Q": d.T @ p["R"], "b": d.sum(axis=0)}.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = p[k] + np.float32(rate * (1 - (t - 1) / steps) + 1e-3) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
    return p


def log10_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10 P(unit | unit before): one matrix product over all contexts."""
    score = (p["R"] @ p["Q"].T + p["b"]).astype(np.float64)
    top = score.max(axis=1, keepdims=True)
    return (score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))) / np.log(10)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. A null id is in no fold and so in training. Rows that repeat an id are
    scored once each. With no training text every word is unseen and both scores come from empty counts. Other columns are
    not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    training = picked.where(~held)
    n_ends = training.count()
    counts = materialize(word_counts(training), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = (sums["n"] or 0) + n_ends
    vocabulary = sums["v"] + (1 if n_ends else 0)

    # the smallest count that at most COMMON_WORDS words reach, from a histogram with eight steps an octave
    step = F.floor(F.log2("n") * 8).cast("int")
    lowest, upto = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["s"]):
        upto += r["k"]
        if upto > COMMON_WORDS:
            break
        lowest = r["s"]
    is_common = F.lit(False) if lowest is None else step >= lowest
    common = counts.where(is_common).unionByName(counts.orderBy(F.col("n").desc(), "hash").limit(OWN_UNITS)).distinct()
    common = common.toPandas().sort_values(["n", "hash"], ascending=[False, True])
    c_hash, c_n = common["hash"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    own_n = min(OWN_UNITS, len(c_hash))
    unit_of_common = common["unit"].to_numpy(np.int64).copy()
    unit_of_common[:own_n] = np.arange(own_n)
    order = np.argsort(c_hash)
    c_hash, c_n, unit_of_common = c_hash[order], c_n[order], unit_of_common[order]
    is_own = unit_of_common < OWN_UNITS
    own, unit_of_own = c_hash[is_own], unit_of_common[is_own]

    pairs = np.zeros(UNITS * UNITS)
    for r in pair_counts(training, own, unit_of_own).toPandas().itertuples(index=False):
        pairs[r.cell] = r.n
    table = log10_table(train_nce(pairs.reshape(UNITS, UNITS)))

    # what the words of a shared unit have together: their count and how many there are
    total, types = np.zeros(UNITS), np.zeros(UNITS)
    for r in counts.groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        total[r["unit"]], types[r["unit"]] = r["n"], r["k"]
    shared_of_own = common["unit"].to_numpy(np.int64)[:own_n]
    np.subtract.at(total, shared_of_own, common["n"].to_numpy(np.float64)[:own_n])
    np.subtract.at(types, shared_of_own, 1)
    # in a shared unit with no words, the unseen word is the only outcome
    unseen = np.log10(np.where(types > 0, DISCOUNT * types, 1.0) / np.where(types > 0, total, 1.0))
    log_total = np.log10(np.where(total > 0, total, 1.0))
    base_floor = n_train + vocabulary + 1
    sent = spark.sparkContext.broadcast((c_hash, c_n, unit_of_common, own, unit_of_own, table))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_hash, c_n, unit_of_common, own, unit_of_own, table = sent.value
        flat = table.ravel()
        for batch in slices(batches, "text"):
            codes, first, words = word_codes(batch.column("text"), lower=True)
            h = _hashes(words)
            unit = np.append(_units(words, h, own, unit_of_own), END)
            n = np.zeros(len(words) + 1, np.int64)
            if len(c_hash) and len(words):
                at = np.minimum(np.searchsorted(c_hash, h), len(c_hash) - 1)
                n[:-1] = np.where(c_hash[at] == h, c_n[at], 0)
            rare = n == 0
            n[-1], rare[-1] = n_ends, False
            inside = np.where((unit < OWN_UNITS) | (unit == END) | rare, 0.0, np.log10(np.maximum(n - DISCOUNT, 1e-300)) - log_total[unit])
            base = np.where(rare, 0.0, np.log10((n + 1.0) / base_floor))
            codes, first = _with_ends(codes, first, len(words))
            heads = first[:-1]
            after = unit[codes]
            before = np.concatenate([[END], after[:-1]])
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            score = np.add.reduceat(flat[before * UNITS + after] + inside[codes], heads)
            base_sum = np.add.reduceat(base[codes], heads)
            known = np.add.reduceat(((n > 0) & ~rare)[codes].astype(np.int64), heads)
            out = np.flatnonzero(rare[codes])
            key = np.sort(doc[out] * np.int64(len(words) + 1) + codes[out])
            which = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(which, len(key)))
            owner, word = key[which] // (len(words) + 1), key[which] % (len(words) + 1)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(known), pa.array(base_sum), pa.array(score), lists(np.append(h, 0)[word]), lists(times.astype(np.int32)), lists(unit[word].astype(np.int32))],
                ["doc_id", "n_tokens", "known", "base", "model", "hash", "times", "unit"],
            )

    schema = "doc_id bigint, n_tokens bigint, known bigint, base double, model double, hash array<bigint>, times array<int>, unit array<int>"
    marked = bounded(picked).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    marked = materialize(marked, "marked")
    rare = marked.select("row", F.explode(F.arrays_zip("hash", "times", "unit")).alias("w")).select("row", "w.hash", "w.times", "w.unit")
    found = rare.join(counts.where(~is_common).select("hash", "n"), "hash", "left")
    per_unit = F.array(*[F.lit(float(x)) for x in log_total[OWN_UNITS:END]])
    per_unseen = F.array(*[F.lit(float(x)) for x in unseen[OWN_UNITS:END]])
    place = F.col("unit") - OWN_UNITS
    parts = found.groupBy("row").agg(
        F.sum("times").alias("_all"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1.0) / F.lit(float(base_floor)))).alias("_base"),
        F.sum(F.col("times") * F.when(F.col("n").isNull(), F.get(per_unseen, place)).otherwise(F.log10(F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(1e-300))) - F.get(per_unit, place))).alias("_model"),
    )
    zero = F.lit(0)
    return marked.drop("hash", "times", "unit").join(parts, "row", "left").select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", zero)).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("_model", zero)).alias("score"),
    )
