"""What the operators share: written intermediate tables, id ranges, word splitting, disjoint sets."""

from __future__ import annotations

import ctypes
import functools
import json
import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; a cluster is an error,
    as a folder of one machine would lose data with it."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = set_dir.get() if set_dir.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


_WRITTEN = threading.local()  # paths of intermediate tables that stand, oldest first, by thread


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by free() or else when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    _WRITTEN.__dict__.setdefault("paths", []).append(path)
    return path


def standing() -> int:
    """How many intermediate tables of this thread stand: a mark for free()."""
    return len(_WRITTEN.__dict__.setdefault("paths", []))


def free(spark: SparkSession, since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete this thread's intermediate tables written after the mark, but for those that keep's materialized tables are read from.

    To be called once nothing lazy reads them any more, as when the table made of them has been written.
    """
    stay = {df._written_at for df in keep}
    paths = _WRITTEN.__dict__.setdefault("paths", [])
    for path in paths[since:]:
        if path not in stay:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    paths[since:] = [p for p in paths[since:] if p in stay]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def enough_partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Shuffle partitions, or more of them where df's files are larger than that many times bytes_each. From the plan's statistics, no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = partitions(df.sparkSession)
    return few if size > 1 << 60 else min(max(few, -(-size // bytes_each)), 100_000)


def id_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points that split the ids in col into ranges of about equal count. Reads that column only."""
    if n < 2:
        return []
    cuts = df.where(F.col(col).isNotNull()).agg(F.percentile_approx(col, [k / n for k in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def literal_longs(values: list[int | None]) -> Column:
    """A constant array<bigint>. It is one string in the plan, folded once, so thousands of values don't deepen the plan."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_of(col: Column, bounds: list[int]) -> Column:
    """Number of cut points at or below the id: its range, 0 for null ids. A search in two levels, JVM-side: about 2 sqrt(n) steps an id."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    cuts, heads = literal_longs(bounds), literal_longs(bounds[::step])
    block = F.size(F.filter(heads, lambda c: c <= col))  # heads of blocks at or below the id; the last of them may end inside its block
    inside = F.size(F.filter(F.slice(cuts, F.greatest((block - 1) * step + 1, F.lit(1)), F.lit(step)), lambda c: c <= col))
    return F.when(col.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + inside)


def bounded(df: DataFrame) -> DataFrame:
    """df, with record batches to Python of at most BATCH_BYTES: by default they are bounded by rows alone.

    The bound is a setting of the session that is read when a plan runs. A session that already holds a bound up to that keeps its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice's text stays near max_bytes; one longer text makes a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def lean(run: Callable) -> Callable:
    """A kernel over Arrow batches that gives its freed memory back when its task ends: Python workers are reused and would keep it."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return lean_run


def _from_zero(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The same texts, without nulls, with offsets that count from zero, on the same bytes. A slice cast to large strings keeps offsets into
    the bytes before it, which pc.ascii_lower (pyarrow 23) returns beside the slice's own bytes: reads beyond their end."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = pa.py_buffer(b"") if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), data)


def word_codes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (code of every word, first word of each text plus the end, distinct words)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(_from_zero(texts))
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    offsets = offsets - offsets[0]
    if b"" in words:  # leading or trailing white space leaves empty parts
        empty = words.index(b"")
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes[codes > empty] -= 1
        del words[empty]
    return codes, offsets, words


class Sets:
    """Disjoint sets over 0..n-1; the root is each set's smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b = a[apart], b[apart]
            lo, hi = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            self.parent[hi] = lo

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A star for each set: (member, root) for every member that is no root."""
        root = self.flatten()
        members = np.flatnonzero(root != np.arange(len(root)))
        return members, root[members]
