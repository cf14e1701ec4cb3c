"""Document fingerprints by winnowing, in built-in expressions only.

The words of a text (lower-cased, split at ASCII white space) give rolling hashes of K
consecutive words: a cyclic polynomial, built by doubling from the words' XXH64. Of every
WINDOW consecutive hashes the smallest is kept, the rightmost one on ties, so any run of
K + WINDOW - 1 words that two texts share gives them a hash in common. What is carried from
window to window is the position of the smallest hash, so hashes keep all their 64 bits and
any position fits. Window minima come by doubling too, so a text costs a fixed number of
passes over its words whatever K and WINDOW are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import id_bounds, literal_longs, partitions, range_of

K = 5
WINDOW = 8


def _rotated(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by % 64 else h


def _with_joined(df: DataFrame, to: str, left: str, right: str, ahead: int, f, kind: str) -> DataFrame:
    """to[i] = f(left[i], right[i + ahead]) for all i where both are. Each step is a projection of its own, so nothing is worked out twice."""
    n = F.least(F.size(left), F.size(right) - ahead)
    return df.withColumn(to, F.when(n > 0, F.zip_with(F.slice(left, F.lit(1), F.greatest(n, F.lit(0))), F.slice(right, F.lit(1 + ahead), F.greatest(n, F.lit(0))), f)).otherwise(F.array().cast(f"array<{kind}>")))


def _with_folded(df: DataFrame, to: str, source: str, length: int, f, kind: str = "bigint") -> DataFrame:
    """to[i] = source[i..i + length - 1] combined by f(left, right, words on the right), by doubling."""

    def of(n: int):
        return lambda a, b: f(a, b, n)

    width, at = 1, source
    for bit in bin(length)[3:]:
        df = _with_joined(df, to + "_w", at, at, width, of(width), kind)
        width, at = 2 * width, to
        df = df.withColumn(to, F.col(to + "_w")).drop(to + "_w")
        if bit == "1":
            df = _with_joined(df, to + "_w", to, source, width, of(1), kind)
            df = df.withColumn(to, F.col(to + "_w")).drop(to + "_w")
            width += 1
    return df if at == to else df.withColumn(to, F.col(source))


def with_fingerprint(df: DataFrame, text_col: str, to: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with to: struct<hash: array<bigint>, position: array<int>> of the kept grams in order of position, first word from 0.

    A text of fewer words than k is one gram, its whole sequence; one without words, null included, gives empty arrays.
    With fewer grams than window, the smallest of them is kept. Of equal hashes in a window the rightmost is.
    """
    w, h, g, i, m = (f"_{to}_{x}" for x in "whgim")
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    df = _with_folded(df, g, h, k, lambda a, b, n: _rotated(a, n).bitwiseXOR(b))
    short = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: _rotated(acc, 1).bitwiseXOR(x))
    df = df.withColumn(g, F.when(F.size(h) >= k, F.col(g)).when(F.size(h) > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))).drop(h)
    df = df.withColumn(i, F.transform(g, lambda _, at: at))
    later = lambda a, b, n: F.when(F.get(F.col(g), b) <= F.get(F.col(g), a), b).otherwise(a)
    df = _with_folded(df, m, i, window, later, "int")
    least = F.size(g) - F.array_position(F.reverse(F.col(g)), F.array_min(g)).cast("int")
    df = df.withColumn(m, F.when(F.size(g) >= window, F.array_distinct(m)).when(F.size(g) > 0, F.array(least)).otherwise(F.array().cast("array<int>"))).drop(i)
    return df.withColumn(to, F.struct(F.transform(m, lambda at: F.get(F.col(g), at)).alias("hash"), F.col(m).alias("position"))).drop(g, m)


def hashes(kept: Column) -> Column:
    """The distinct kept hashes."""
    return F.array_distinct(kept["hash"])


def digest(kept: Column) -> Column:
    """32 hex digits of the kept hashes and positions."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(kept)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), kept)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common.cast("double") / (F.size(a) + F.size(b) - common))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint): array of struct<hash, position> for every row. Null and wordless texts give empty arrays."""
    marked = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "kept", k, window)
    return marked.select("doc_id", F.arrays_zip("kept.hash", "kept.position").alias("fingerprint"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_kept.

    A document's edited text has its last floor(n_chars / 2) code points replaced by as many of the first of the next
    document, or all it has; the next one has the next smaller id, and the last one's next is the first. Null ids come
    last. Rows that repeat an id follow one another in order of a hash of their texts. Other columns are not read.

    Ids are cut into ranges of about equal count. A range's first row also goes, as a guest, to the range before it in
    descending order, so one shuffle of the texts is all it takes, and no row waits for a global order.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = id_bounds(picked, "doc_id", partitions(spark))
    pid = range_of(F.col("doc_id"), bounds)
    # at most as many rows as ranges come to the driver
    tops = {r["pid"]: r["top"] for r in picked.groupBy(pid.alias("pid")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    before = dict(zip(order, [order[-1], *order[:-1]] if order else []))
    by_range = lambda of: F.get(literal_longs([of.get(p) for p in range(len(bounds) + 1)]), pid)
    guests = F.when(F.col("doc_id").eqNullSafe(by_range(tops)), by_range(before).cast("int"))
    own = F.struct(pid.alias("pid"), F.lit(False).alias("guest"))
    seat = F.when(guests.isNull(), F.array(own)).otherwise(F.array(own, F.struct(guests.alias("pid"), F.lit(True).alias("guest"))))
    seated = picked.withColumn("tie", F.xxhash64("text")).withColumn("seat", F.explode(seat)).select("doc_id", "text", "tie", "seat.pid", "seat.guest")
    rows = Window.partitionBy("pid").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = seated.withColumn("next", F.lead("text").over(rows)).withColumn("n_chars", n.cast("bigint"))
    paired = paired.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(F.concat(F.left("text", n - half), F.left("next", half)))).drop("next")
    marked = with_fingerprint(paired, "text", "kept", k, window).drop("text")
    marked = marked.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    marked = with_fingerprint(marked, "edited", "edited_kept", k, window).drop("edited")
    marked = marked.withColumn("h", hashes(F.col("kept")))
    marked = marked.withColumn("h_next", F.lead("h").over(rows)).where(~F.col("guest"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("kept")).alias("fingerprint"),
        digest(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("h"), hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("h"), F.col("h_next")).alias("near_next"),
        F.size("kept.position").cast("bigint").alias("n_kept"),
    )
