"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Copies share a
fingerprint, so only distinct fingerprints are compared. The 64 bits are cut into six
blocks: two fingerprints at 4 or fewer differing bits agree on at least two whole
blocks, so each lies with the other in one of 15 tables keyed by two blocks. Inside a
table's bucket the fingerprints stand as vertical bit planes, 64 to a machine word; a
query updates 64 distances at once through a carry-save counter and a word is abandoned
once all its lanes exceed the radius. Buckets beyond a size are cut into chunks that are
compared chunk by chunk in different tasks. Each task emits a spanning star of what it
linked, never the pairs, and components are found over those stars.

similar_documents() is the form for a wanted likeness of shingle sets. A radius of a few of
64 bits is far too small for that: at a likeness of 0.8 fingerprints differ in 15 % of bits.
So it takes 256 bits: half of them are compared, at a radius that follows from the likeness,
and random choices of the other half key the tables. Keys get longer with the number of
documents, so that buckets stay at about the 64 lanes of a machine word, and the number of
tables follows, so that recall stays. The comparison is the same. What it finds are candidates only: a pair is
linked where the Jaccard likeness of the two whole shingle sets, counted exactly, reaches the
wanted one. Majorities of few shingles differ more often, so short texts are looked up by
shingles instead: of two sets at the likeness the smallest hashes of each share one. First each set is
held against its nearest candidate alone, by a join. Where that leaves parts of a connected group of candidates
apart, the group's sets are dealt to tasks in chunks, two a task, which verify the pairs and emit stars of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import Sets, bounded, free, lean, materialize, partitions, standing
from lodestone.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BUCKET = 65_536
SHORT_TEXT = 32
MISSED = 5e-4


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle_words + 1
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist())]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; null and wordless texts give zero."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle_words) for t in map(pa.StringScalar.as_py, batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["id", "fp"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded(picked).mapInArrow(run, "id bigint, fp bigint")


def bit_sliced_links(fps: np.ndarray, end: np.ndarray, radius: int, chunk: int = 1 << 18) -> Sets:
    """Sets of row numbers linked at radius or less. Row i is compared with the rows after it and before end[i].

    fps holds one or more 64-bit words a row. Counters start so high that their carry out says that a lane has gone
    beyond the radius.
    """
    if not len(fps):
        return Sets(0)
    fps = fps.reshape(len(fps), -1)
    n, n_bits = len(fps), 64 * fps.shape[1]
    sets = Sets(n)
    words = -(-n // 64)
    one, full = np.uint64(1), ~np.uint64(0)
    planes = np.empty((n_bits, words), np.uint64)
    lane_bits = one << np.arange(64, dtype=np.uint64)
    for k in range(fps.shape[1]):
        padded = np.zeros(words * 64, np.uint64)
        padded[:n] = fps[:, k]
        lanes = padded.reshape(words, 64)
        for b in range(64):
            planes[64 * k + b] = (((lanes >> np.uint64(b)) & one) * lane_bits).sum(axis=1, dtype=np.uint64)
    first = np.arange(n) + 1
    n_words = np.where(end > first, (end - 1) // 64 - first // 64 + 1, 0)
    digits = (radius + 1).bit_length()
    preset = (1 << digits) - (radius + 1)
    upto = np.cumsum(n_words)
    at = 0
    while at < n:  # rows at..to give about chunk (row, word) pairs
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
        count = n_words[at:to]
        row = np.repeat(np.arange(at, to), count)
        word = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row] // 64
        lo = np.clip(first[row] - word * 64, 0, 64)
        hi = np.clip(end[row] - word * 64, 0, 64)
        below = lambda k: np.where(k >= 64, full, (one << np.minimum(k, 63).astype(np.uint64)) - one)
        over = ~(below(hi) & ~below(lo))  # lanes outside the row's range count as beyond the radius
        counter = [np.full(len(row), full if preset >> d & 1 else np.uint64(0)) for d in range(digits)]
        for b in range(n_bits):
            if not len(row):
                break
            carry = planes[b][word] ^ (np.uint64(0) - ((fps[row, b // 64] >> np.uint64(b % 64)) & one))
            for d in range(digits):  # carry-save addition of one bit to every lane's counter
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            over |= carry
            if b > radius and b % 8 == 7 or b + 1 == n_bits:
                alive = over != full
                if not alive.all():
                    row, word, over = row[alive], word[alive], over[alive]
                    counter = [c[alive] for c in counter]
        if len(row):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(near)
            sets.union(row[k], word[k] * 64 + lane)
        at = to
    return sets


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n nearly equal blocks of 64 bits."""
    sizes = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(n)]


def link_fingerprints(distinct: DataFrame, radius: int = 4, agree: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links that connect the representatives rep of all distinct fingerprints fp within radius.

    radius + agree blocks, of which agree must match: more of them make smaller buckets and more tables.
    """
    blocks = _blocks(radius + agree)
    tables = []
    for t, chosen in enumerate(combinations(blocks, agree)):
        key = F.lit(0).cast("bigint")
        for start, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    keys = distinct.select("rep", "fp", F.explode(F.array(*tables)).alias("k")).select("rep", "fp", "k.t", "k.key")
    return _compared(keys.select("t", "key", "rep", F.col("fp").alias("f0")), 1, radius, max_bucket)


def near_pairs(fps: np.ndarray, sets: Sets, radius: int, n: np.ndarray, similarity: float, linked: Sets, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance): each row b with the nearest row a before it, of those in one set, within radius and of sizes n that allow the likeness.

    All pairs that fulfil these conditions, nearest or not, are united in linked.
    """
    root = sets.flatten()
    order = np.argsort(root, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(order)))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def unite(least):
        if sum(len(a) for a, _ in waiting) > least:
            linked.union(np.concatenate([a for a, _ in waiting]), np.concatenate([b for _, b in waiting]))
            waiting.clear()

    def near(a, b):
        distance = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)
        ok = (distance <= radius) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
        a, b, distance = a[ok], b[ok], distance[ok]
        waiting.append((a, b))
        unite(chunk)
        if len(b):
            best = np.lexsort((a, distance, b))
            best = best[np.concatenate([[True], b[best][1:] != b[best][:-1]])]
            a, b, distance = a[best], b[best], distance[best]
        return a, b, distance

    small = 32
    for m in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():
        members = order[heads[sizes == m][:, None] + np.arange(m)]
        i, k = np.triu_indices(m, 1)
        step = max(1, chunk // len(i))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            yield near(part[:, i].ravel(), part[:, k].ravel())
    for head, m in zip(heads[sizes > small].tolist(), sizes[sizes > small].tolist()):
        members = order[head : head + m]
        for at in range(1, m):
            found = near(members[:at], np.repeat(members[at], at))
            if len(found[0]):
                yield found
    unite(0)


def alike_links(fps: np.ndarray, n: np.ndarray, known: np.ndarray, own: np.ndarray, elements: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the sets whose exact likeness reaches similarity, of those within radius and of different known components.

    elements holds the sets one after the other, n elements each. Where own, the sets' chunks, has two values, only pairs across are compared.
    """
    m = len(n)
    starts = np.cumsum(n) - n
    code = np.unique(elements, return_inverse=True)[1]
    holders = np.repeat(np.arange(m), n)[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    across = len(np.unique(own)) > 1
    sets = Sets(m)
    for k in range(1, m):
        distance = np.bitwise_count(fps[:k] ^ fps[k]).sum(axis=1, dtype=np.int64)
        near = (distance <= radius) & (np.minimum(n[:k], n[k]) >= similarity * np.maximum(n[:k], n[k])) & (known[:k] != known[k])
        if across:
            near &= own[:k] != own[k]
        at = np.flatnonzero(near)
        if not len(at):
            continue
        common = np.zeros(m, np.int64)
        mine = code[starts[k] : starts[k] + n[k]]
        firsts = np.where(mine > 0, ends[mine - 1], 0)
        counts = ends[mine] - firsts
        for lo in range(0, len(mine), 1 << 16):
            hi = min(len(mine), lo + (1 << 16))
            c = counts[lo:hi]
            places = np.repeat(firsts[lo:hi] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            common += np.bincount(holders[places], minlength=m)
        found = at[common[at] / (n[at] + n[k] - common[at]) >= similarity]
        sets.union(found, np.full(len(found), k))
    return sets.links()


def _compared(keys: DataFrame, n_words: int, radius: int, max_bucket: int, similarity: float = 0.0) -> DataFrame:
    """(a, b): stars over the rows (t, key, rep, f0, ...) that share a bucket (t, key) and lie within radius.

    With similarity it is (a, b, distance), as near_pairs() gives them for sets of the sizes in a column n, and stars over all near pairs,
    whose distance is null.
    """
    spark = keys.sparkSession
    known = ["n"] if similarity else []
    prints = [f"f{k}" for k in range(n_words)]
    big = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).select("t", "key", F.ceil(F.col("n") / max_bucket).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, own) * F.col("chunks") + F.greatest(o, own))
    parts = keys.join(big, ["t", "key"], "left").select("t", "key", "rep", *prints, *known, F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)).alias("part"))

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = rows[:, :3]
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(axis=1)]))
            sizes = np.diff(np.append(starts, len(rows)))
            end = np.repeat(starts + sizes, sizes)
            several = np.repeat(sizes > 1, sizes)  # lone rows take no lane
            rows, end = rows[several], (np.concatenate([[0], np.cumsum(several)])[end])[several]
            words = np.ascontiguousarray(rows[:, 4 : 4 + n_words]).view(np.uint64)
            sets = bit_sliced_links(words, end, radius)
            if not similarity:
                a, b = sets.links()
                yield pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], ["a", "b"])
                return
            linked = Sets(len(rows))
            for a, b, distance in near_pairs(words, sets, radius, rows[:, 4 + n_words], similarity, linked):
                yield pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3]), pa.array(distance)], ["a", "b", "distance"])
            b, a = linked.links()
            yield pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3]), pa.nulls(len(a), pa.int64())], ["a", "b", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "part", "rep", *prints, *known)], axis=1)
            rows = np.concatenate([*held, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield from work(rows[:cut])
            held = [rows[cut:]]
        if held and len(held[0]):
            yield from work(held[0])

    dealt = parts.repartition(partitions(spark), "t", "key", "part").sortWithinPartitions("t", "key", "part", "rep")
    return dealt.mapInArrow(compare, "a bigint, b bigint" + (", distance bigint" if similarity else ""))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle_words: int = SHINGLE_WORDS, agree: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id reachable through links of radius or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are
    returned once each and share a component where their texts do. A row with a null id gets the
    component of its fingerprint's other rows, null if there are none. Other columns are not read.
    An empty table gives an empty table. agree blocks of equal bits key a table; unless given, more of them do in larger tables,
    so that buckets don't grow with the corpus. No pair within the radius is missed either way.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("rep"))
    classes = materialize(distinct.where(F.col("rep").isNotNull()), "classes")
    if agree is None:  # keys of about 21, 27 and 32 bits
        n = classes.count()
        agree = 2 if n < 1 << 27 else 3 if n < 1 << 33 else 4
    # an id may stand in two rows with different texts, and so for two fingerprints: its links then join both
    nodes = connected_components(link_fingerprints(classes, radius, agree, max_bucket))
    of = classes.join(nodes, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return marked.join(of, "fp", "left").select("id", "fp", "component")


#: A group of candidates is cut into chunks of so many sets, but into no more than GROUP_CHUNKS; beyond that into chunks of so many sets or shingles.
GROUP_ROWS = (128, 16_384)
GROUP_CHUNKS = 16
GROUP_SHINGLES = 1 << 20
WIDE_WORDS = 4
COMPARED_WORDS = 2  # the other words key the tables
_SALTS = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """256-bit SimHash of a set of shingle hashes, as four unsigned words."""
    out = []
    for salt in _SALTS:
        x = (shingles ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(32))))
    return out


def key_plan(n: int, similarity: float, key_bits: int | None = None, tables: int | None = None) -> tuple[int, int]:
    """(bits of a key, tables) for n distinct sets: buckets of about 64 sets, and a pair of large sets at the likeness in no common bucket once in 1 / MISSED."""
    key_bits = key_bits or max(10, min(24, math.ceil(math.log2(max(n, 2))) - 6))
    agree = (1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) ** key_bits
    return key_bits, tables or (1 if agree >= 1 else math.ceil(math.log(MISSED) / math.log1p(-agree)))


def wide_radius(similarity: float, bits: int = 64 * COMPARED_WORDS) -> int:
    """Bits that a pair at a Jaccard likeness differs in at most, but for about one in a thousand.

    That is 3.3 standard deviations beyond the mean, taken a quarter above the share of large sets: at 0.8 large sets differ
    in 15 % of bits, sets of four and five shingles in 19 %.
    """
    share = min(0.5, 1.25 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    return math.floor(bits * share + 3.3 * math.sqrt(bits * share * (1 - share)))


def least_hashes(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """So many smallest hashes of a sorted set that any two sets at the likeness share one of them."""
    return shingles[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]


def _alike(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle_words: int, key_bits: int | None, tables: int | None, max_bucket: int) -> DataFrame:
    """(id, x, least): rows by id and xxhash64 of the text, and the least (id, x) of what each is connected with."""
    radius = wide_radius(similarity)
    prints = [f"f{k}" for k in range(WIDE_WORDS)]
    shingles = lambda t: np.unique(shingle_hashes(t, shingle_words))

    @lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digest, short, n = [], [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py())
                fps.append(wide_fingerprint(h))
                digest.append(xxh64_intdigest(h.tobytes(), SEED))
                n.append(len(h))
                short.append(least_hashes(h, similarity).view(np.int64) if 0 < len(h) <= SHORT_TEXT else [])
            fps = np.array(fps, np.uint64).reshape(-1, WIDE_WORDS)
            columns = [pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(short, pa.list_(pa.int64()))]
            columns += [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(WIDE_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), *columns], ["id", "x", "d", "n", "short", *prints])

    def key_of(names: list[str]):
        @lean
        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                # a set this large may have a partner beyond SHORT_TEXT, which has no shingle keys
                rows = pa.Table.from_batches([batch])
                large = rows.filter(rows.column("n").to_numpy() > similarity * SHORT_TEXT).combine_chunks()
                fps = np.stack([large.column(c).to_numpy() for c in prints[COMPARED_WORDS:]], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1 if len(fps) else 8), axis=1, bitorder="little")
                weights = 1 << np.arange(key_bits)
                for t, at in enumerate(chosen if len(fps) else []):
                    columns = {"t": np.full(len(fps), t, np.int32), "key": bits[:, at].astype(np.int64) @ weights}
                    yield from pa.table({**columns, **{c: large.column(c) for c in names}}).to_batches()
                short = batch.column("short")
                at = np.repeat(np.arange(len(batch)), short.value_lengths().to_numpy(zero_copy_only=False))
                if len(at):
                    columns = {"t": np.full(len(at), -1, np.int32), "key": short.flatten()}
                    yield from pa.table({**columns, **{c: rows.column(c).take(pa.array(at)) for c in names}}).to_batches()

        return key

    @lean
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))], ["d", "s"])

    wide = ", ".join(f"{c} bigint" for c in prints)
    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = bounded(picked.select("id", F.xxhash64("text").alias("x"), "text"))
    marked = materialize(picked.mapInArrow(mark, f"id bigint, x bigint, d bigint, n int, short array<bigint>, {wide}"), "wide-fingerprints")
    classes = materialize(marked.groupBy("d", "n", "short", *prints).agg(F.min(F.struct("id", "x")).alias("least")), "wide-classes")
    key_bits, tables = key_plan(classes.count(), similarity, key_bits, tables)
    rng = np.random.default_rng(SEED)
    chosen = [np.sort(rng.permutation(64 * (WIDE_WORDS - COMPARED_WORDS))[:key_bits]) for _ in range(tables)]

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows and elements of one (group, part)

        def work() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate([r for r, _ in held])
            words = np.ascontiguousarray(rows[:, 6:]).view(np.uint64)
            a, b = alike_links(words, rows[:, 5], rows[:, 4], rows[:, 2], np.concatenate([e for _, e in held]), radius, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g", "part", "own", "d", "known", "n", *prints[:COMPARED_WORDS])], axis=1)
            elements = batch.column("s").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(rows[:, 5])])
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if hi > lo:
                    if held and (held[0][0][0, :2] != rows[lo, :2]).any():
                        yield from work()
                        held.clear()
                    held.append((rows[lo:hi], elements[ends[lo] : ends[hi]].copy()))
        if held:
            yield from work()

    nodes = classes.where("n > 0").withColumn("n", F.col("n").cast("bigint")).withColumnRenamed("d", "rep")
    sent = ["rep", *prints[:COMPARED_WORDS], "n"]
    keys = nodes.select("n", "short", "rep", *prints).mapInArrow(key_of(sent), f"t int, key bigint, {', '.join(f'{c} bigint' for c in sent)}")
    pairs = _compared(keys, COMPARED_WORDS, radius, max_bucket, similarity)
    found = materialize(pairs.groupBy("a", "b").agg(F.min("distance").alias("distance")), "found")
    asked = found.select(F.col("a").alias("d")).union(found.select(F.col("b").alias("d"))).distinct()
    rows = classes.join(asked, "d").select("d", "least.id", "least.x")
    texts = picked.join(rows, ["id", "x"]).dropDuplicates(["id", "x"]).select("d", "text")
    sets = materialize(bounded(texts).mapInArrow(whole, "d bigint, s array<bigint>"), "shingle-sets")
    # first each set with the nearest candidate before it, so that a group of copies costs a pair a copy, however many buckets it meets in
    nearest = found.where(F.col("distance").isNotNull()).groupBy("b").agg(F.min(F.struct("distance", "a")).alias("e")).select("e.a", "b")
    both = nearest.join(sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = materialize(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"), "verified")
    of = connected_components(links)
    # then, in each group connected by candidates, the pairs that this left apart
    grouped = connected_components(found).select(F.col("node").alias("d"), F.col("component").alias("g"))
    grouped = grouped.join(of, F.col("d") == F.col("node"), "left").select("d", "g", F.coalesce("component", "d").alias("known"))
    grouped = materialize(grouped.join(classes.select("d", F.col("n").cast("bigint").alias("n"), *prints[:COMPARED_WORDS]), "d"), "groups")
    chunks = F.greatest(F.least(F.ceil(F.count(F.lit(1)) / GROUP_ROWS[0]), F.lit(GROUP_CHUNKS)), F.ceil(F.count(F.lit(1)) / GROUP_ROWS[1]), F.ceil(F.sum("n") / GROUP_SHINGLES))
    apart = grouped.groupBy("g").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), chunks.cast("int").alias("chunks")).where("lo < hi").select("g", "chunks")
    dealt = grouped.join(apart, "g").withColumn("own", F.pmod(F.xxhash64("d", F.lit(7)), F.col("chunks")).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, F.col("own")) * F.col("chunks") + F.greatest(o, F.col("own")))
    dealt = dealt.join(sets, "d").select("g", "own", "d", "known", "n", *prints[:COMPARED_WORDS], "s", F.explode(parts).alias("part"))
    dealt = bounded(dealt.repartition(partitions(docs.sparkSession), "g", "part").sortWithinPartitions("g", "part", "d"))
    more = materialize(dealt.mapInArrow(verify, "a bigint, b bigint"), "more")
    if more.limit(1).count():
        of = connected_components(links.unionByName(more))
    joined = classes.select("d", "least").join(of, F.col("d") == F.col("node"), "left").select("d", "least", F.coalesce("component", "d").alias("c"))
    least = joined.groupBy("c").agg(F.min("least").alias("least"))
    return marked.select("id", "x", "d").join(joined.select("d", "c"), "d").join(least, "c").select("id", "x", "least")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5, key_bits: int | None = None, tables: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, component): documents in components of pairs whose shingle sets are alike at similarity or more.

    Every link is verified on the whole shingle sets. key_plan() sets the tables so that a pair of long texts right at the
    likeness shares a bucket with probability 0.9995; one of short texts always does. Null and empty texts are alike.
    Rows with a null id are left out. Rows that repeat an id are returned once each.
    """
    return _alike(docs, id_col, text_col, similarity, shingle_words, key_bits, tables, max_bucket).select("id", F.col("least.id").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5, key_bits: int | None = None, tables: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs with one row of each component of similar_documents(), one of the smallest id, all columns kept.

    Rows with a null id stay, as nothing can be told apart by it. Rows are told apart by id and text: where an id stands
    in rows of different texts, each text is judged by itself.
    """
    names = docs.columns
    before = standing()
    found = materialize(_alike(docs, id_col, text_col, similarity, shingle_words, key_bits, tables, max_bucket), "similar")
    free(docs.sparkSession, before, (found,))
    stay = found.where(F.struct("id", "x") == F.col("least")).groupBy("id", "x").agg(F.count(F.lit(1)).alias("n"))
    chosen = stay.select(F.col("id").alias("_stay"), F.col("x").alias("_stay_x"))
    marked = docs.withColumn("_x", F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(chosen, (marked[id_col].cast("bigint") == F.col("_stay")) & (F.col("_x") == F.col("_stay_x")), "left_semi")
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, "_x"])
    return kept.select(*names).unionByName(docs.where(F.col(id_col).isNull()).select(*names))
