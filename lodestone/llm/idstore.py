"""Token-id shards with minimal perfect hash indexes.

A store is a Parquet table in the shared folder, one row per shard, readable by any engine:

    pid, seq      range of ids and position of the shard within it, in ascending order of keys
    before        ids in earlier shards of the same range
    first, last   smallest and largest doc_id of the shard, by which a keyed read finds its shards; null ids count as the least long
    n_docs, n_ids documents and ids in the shard
    width         bytes per id in the payload: 2 if every id fits, else 4
    payload       the ids of all documents of the shard in ascending order of keys, little-endian, back to back
    seeds         minimal perfect hash: little-endian uint32 displacement of each bucket
    fingerprints  by slot: little-endian uint32 fingerprint of the key
    offsets       by slot: little-endian uint64 first id in the payload
    lengths       by slot: little-endian uint64 number of ids
    keys          the documents' keys in ascending order, little-endian int64 pairs (doc_id, occurrence)

A key's bucket comes from one hash and its slot from a second one mixed with the bucket's
displacement; n keys fill exactly the slots 0..n-1, so a lookup is two hashes and one
fingerprint comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, enough_partitions, fresh_path, id_bounds, lean, literal_longs, range_of, slices
from lodestone.llm.tokens import encoder, with_end

KEYS_PER_BUCKET = 4
SHARD_IDS = 2 << 20
SHARD_DOCS = 1 << 14
ROW_GROUP = 8 << 20
NULL_ID = -(2**63)
STORE = "pid int, seq int, before bigint, first bigint, last bigint, n_docs bigint, n_ids bigint, width int, payload binary, seeds binary, fingerprints binary, offsets binary, lengths binary, keys binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray) -> np.ndarray:
    """64-bit hash of (doc_id, occurrence) rows."""
    k = keys.astype(np.int64).view(np.uint64).reshape(-1, 2)
    return _mix(_mix(k[:, 0] + np.uint64(0x9E3779B97F4A7C15)) ^ (k[:, 1] * np.uint64(0xD6E8FEB86659FD93)))


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h ^ ((seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def _buckets(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def build_index(h: np.ndarray) -> np.ndarray:
    """Displacements that send n distinct key hashes to n distinct slots; the largest buckets are placed first."""
    n = len(h)
    n_buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = _buckets(h, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    first = np.cumsum(sizes) - sizes
    seeds = np.zeros(n_buckets, np.uint32)
    taken = np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[b])
        if not size:
            break
        keys = h[order[first[b] : first[b] + size]]
        at, tries = 0, 32
        while True:
            trial = np.arange(at, at + tries, dtype=np.uint64)
            slots = _slots(np.tile(keys, tries), np.repeat(trial, size), n).reshape(tries, size)
            good = ~taken[slots].any(axis=1)
            if size > 1:
                good &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b] = at + k
                taken[slots[k]] = True
                break
            at, tries = at + tries, min(2 * tries, 1 << 14)
            if at > 1 << 31:
                raise ValueError("keys repeat")
    return seeds


def lookup(keys: np.ndarray, seeds: bytes, fingerprints: bytes) -> np.ndarray:
    """Slot of each (doc_id, occurrence) row, -1 where the stored fingerprint says that the key isn't there."""
    prints = np.frombuffer(fingerprints, "<u4")
    if not len(prints):
        return np.full(len(keys), -1, np.int64)
    h = key_hash(keys)
    seed = np.frombuffer(seeds, "<u4")
    slot = _slots(h, seed[_buckets(h, len(seed))], len(prints))
    return np.where(prints[slot] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), slot, -1)


def _shard(pid: int, seq: int, before: int, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> dict:
    h = key_hash(keys)
    seeds = build_index(h)
    slot = _slots(h, seeds[_buckets(h, len(seeds))], len(h))
    by_slot = lambda values, kind: (out := np.empty(len(values), kind), out.__setitem__(slot, values))[0].tobytes()
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return {
        "pid": pid, "seq": seq, "before": before, "first": int(keys[0, 0]), "last": int(keys[-1, 0]), "n_docs": len(keys), "n_ids": len(ids), "width": width, "payload": ids.astype(f"<u{width}").tobytes(),
        "seeds": seeds.astype("<u4").tobytes(), "fingerprints": by_slot((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), "<u4"),
        "offsets": by_slot(np.cumsum(lengths) - lengths, "<u8"), "lengths": by_slot(lengths, "<u8"), "keys": keys.astype("<i8").tobytes(),
    }


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", by: str = "blanks", special_as_text: bool = False, shard_docs: int = SHARD_DOCS) -> None:
    """Encode every whole text, append end_id, and write shards in ascending order of id; null ids come first.

    Rows that repeat an id are kept, told apart by their occurrence in order of text. Strings of special tokens become their
    ids, as the tokenizer file has it, unless special_as_text is set. A range of ids is one task, ranges are of about equal count.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = id_bounds(picked, "doc_id", enough_partitions(docs))
    ranged = picked.select(range_of(F.col("doc_id"), bounds).alias("pid"), "doc_id", "text")
    dealt = ranged.repartitionById(len(bounds) + 1, F.col("pid")).sortWithinPartitions("pid", F.col("doc_id").asc_nulls_first(), "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("before", "first", "last", "n_docs", "n_ids")), ("width", pa.int32()), *((c, pa.binary()) for c in ("payload", "seeds", "fingerprints", "offsets", "lengths", "keys"))])
        at = {"pid": None, "seq": 0, "before": 0}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = [None, 0]  # the latest id and its occurrences

        def out() -> pa.RecordBatch:
            keys, lengths, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            row = _shard(at["pid"], at["seq"], at["before"], keys, lengths, ids)
            at["seq"] += 1
            at["before"] += len(ids)
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in slices(batches, "text", 4 << 20):
            ids, first = with_end(*encoder(tokenizer_path, by, special_as_text).encode(batch.column("text")), end_id)
            doc = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            pid = batch.column("pid").to_numpy(zero_copy_only=False)
            keys = np.empty((len(doc), 2), np.int64)
            for i, d in enumerate(doc.tolist()):
                last[1] = last[1] + 1 if d == last[0] else 0
                last[0] = d
                keys[i] = d, last[1]
            cuts = [0, *(np.flatnonzero(np.diff(pid)) + 1).tolist(), len(doc)]
            for a, b in zip(cuts, cuts[1:]):
                if at["pid"] != int(pid[a]):
                    if held:
                        yield out()
                    at.update(pid=int(pid[a]), seq=0, before=0)
                held.append((keys[a:b], np.diff(first[a : b + 1]), ids[first[a] : first[b]]))
                if sum(len(x[2]) for x in held) >= SHARD_IDS or sum(len(x[0]) for x in held) >= shard_docs:
                    yield out()
        if held:
            yield out()

    # a row group holds a shard or two, so that a keyed read skips the rest by their statistics
    bounded(dealt).mapInArrow(run, STORE).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back through each shard's index.

    start counts the ids of all documents before it in the store. Totals are kept per range of ids, of which there are
    at most as many as shuffle partitions; those few sums are added up on the driver.
    """
    store = spark.read.schema(STORE).parquet(path)
    totals = sorted((r["pid"], r["n"]) for r in store.groupBy("pid").agg(F.sum("n_ids").alias("n")).collect())
    earlier, upto = {}, 0
    for pid, n in totals:
        earlier[pid] = upto
        upto += n

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<i8").reshape(-1, 2)
                slot = lookup(keys, row["seeds"], row["fingerprints"])
                if (slot < 0).any():
                    raise ValueError(f"shard {row['pid']}-{row['seq']}: a key is missing from its index")
                offset = np.frombuffer(row["offsets"], "<u8")[slot].astype(np.int64)
                length = np.frombuffer(row["lengths"], "<u8")[slot].astype(np.int64)
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                crc = [crc32(ids[a:b]) for a, b in zip(offset.tolist(), (offset + length).tolist())]
                base = earlier[row["pid"]] + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0], mask=keys[:, 0] == NULL_ID), pa.array(base + offset), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("pid", "seq", "before", "width", "payload", "seeds", "fingerprints", "offsets", "lengths", "keys").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def get_documents(spark, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, occurrence, tokens: array<bigint>) of the documents with the given ids; ids that the store lacks give no row.

    Shards whose range of ids holds none of them are skipped by their statistics; in the others each key costs two hashes and a
    comparison, and only its own ids are copied out. As fingerprints have 32 bits, an absent id passes for one of a shard's documents
    once in four billion lookups. ids is a list of the driver's; to look up a table's ids, join read_store().
    """
    wanted = np.unique(np.asarray([i for i in ids if i is not None], np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id bigint, occurrence bigint, tokens array<bigint>")
    store = spark.read.schema(STORE).parquet(path).where((F.col("first") <= int(wanted[-1])) & (F.col("last") >= int(wanted[0])))
    store = store.where(F.exists(literal_longs(wanted.tolist()), lambda i: (F.col("first") <= i) & (i <= F.col("last"))))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                prints = np.frombuffer(row["fingerprints"], "<u4")
                offsets, lengths = np.frombuffer(row["offsets"], "<u8"), np.frombuffer(row["lengths"], "<u8")
                payload = np.frombuffer(row["payload"], f"<u{row['width']}")
                found: list[tuple[int, int, np.ndarray]] = []
                open_ids = wanted[(wanted >= row["first"]) & (wanted <= row["last"])]
                # occurrences of the first id may have begun in the shard before
                occurrence = np.where(open_ids == row["first"], int.from_bytes(row["begun"], "little"), 0)
                for _ in range(len(prints)):
                    slot = lookup(np.stack([open_ids, occurrence], axis=1), row["seeds"], row["fingerprints"])
                    found += [(i, o, payload[int(offsets[k]) : int(offsets[k] + lengths[k])].astype(np.int64)) for i, o, k in zip(open_ids.tolist(), occurrence.tolist(), slot.tolist()) if k >= 0]
                    open_ids, occurrence = open_ids[slot >= 0], occurrence[slot >= 0] + 1
                    if not len(open_ids):
                        break
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["doc_id", "occurrence", "tokens"])

    return store.select("first", "last", F.substring("keys", 9, 8).alias("begun"), "width", "payload", "seeds", "fingerprints", "offsets", "lengths").mapInArrow(run, "doc_id bigint, occurrence bigint, tokens array<bigint>")


def store_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, by: str = "blanks", special_as_text: bool = False) -> DataFrame:
    """Write a store (a new one in the shared folder if no path is given) and return its documents as read back.

    Null and empty texts hold the end id alone; a null id sorts before all others and stays null. An empty table
    gives an empty table. Other columns are not read.
    """
    path = path or fresh_path(docs.sparkSession, "idstore")
    write_store(docs, tokenizer_path, path, end_id, id_col, text_col, by, special_as_text)
    return read_store(docs.sparkSession, path)
