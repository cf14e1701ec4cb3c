"""Sum-of-squares bin packing of token sequences.

A document's ids, with an end id, are cut only if longer than a sequence. Pieces are dealt
to shards of bounded size by a hash; within a shard each piece, longest first, goes where
the sum over residual gaps of the squared count of open bins with that gap becomes
smallest, a new bin included. A shard holds tens of thousands of pieces, so what its last
open bins leave empty is small beside them, however many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, lean, materialize, slices
from lodestone.llm.tokens import encoder, with_end

CAPACITY = 4096
SHARD_PIECES = 50_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece in the order given, and the fill of each bin. Ties go to the smallest gap, then to the bin that came to it last."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and stays 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[size:]) + size
        change = np.where(gaps > size, 2 * count[gaps - size] + 1, 0) - 2 * count[gaps] + 1
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        k = int(np.argmin(change)) if len(gaps) else -1
        if k >= 0 and change[k] <= fresh:
            gap = int(gaps[k])
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - gap
        fill[b] += size
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets, np.asarray(fill, np.int64)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", by: str = "words", special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's whole text as ids plus end_id, cut into pieces of capacity.

    Strings of special tokens become their ids, as the tokenizer file has it, unless special_as_text is set.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, first = with_end(*encoder(tokenizer_path, by, special_as_text).encode(batch.column("text")), end_id)
            ids = ids.astype("<u4")
            n = -(-np.diff(first) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(first[1:][doc] - first[:-1][doc] - start, capacity)
            at = first[:-1][doc] + start
            crc = [crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(picked).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(items: DataFrame, n_items: int, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """items, with a column length of 1 to capacity, plus sequence_id and offset (bigint): gapless from 0 in each sequence.

    n_items is about the number of rows and sets the number of shards, so a task holds a bounded number of pieces.
    """
    names = items.columns
    shards = max(1, -(-n_items // shard_pieces))
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # a total order over all columns, so that a task run again packs alike
        table = table.sort_by([("length", "descending")] + [(c, "ascending") for c in names if c != "length"])
        bins, offsets, _ = sum_of_squares(table.column("length").to_numpy(), capacity)
        shard = table.column("_shard").to_numpy().astype(np.int64)
        out = table.drop_columns(["_shard"])
        return out.append_column("sequence_id", pa.array((shard << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", by: str = "words", shard_pieces: int = SHARD_PIECES, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat an id are packed once each. Null ids are kept.
    Only id and text are read, so other columns may have any names. An empty table gives an empty table. The pieces are
    written once, so that their number, which sets the number of shards, is known and no text is encoded again.
    """
    found = materialize(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, by, special_as_text), "pieces")
    return pack(found, found.count(), capacity, shard_pieces)
