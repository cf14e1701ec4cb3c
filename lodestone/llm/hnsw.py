"""Embedding near-duplicates with hierarchical navigable small-world graphs per shard.

Distinct vectors are dealt to shards by a hash and every shard gets a graph. Every vector
then queries every shard with a beam. A query whose beam ends inside the radius is searched
again with a wider one, and a sample of each block of queries is audited against brute
force, query by query: the whole block's beam is widened until the audit passes. A beam as wide
as the shard is no graph walk but a product with the whole shard, which is exact. Hits are verified by cosine in double precision.
A task loads one graph and streams its share of the queries through it, block by block; it returns each query's number of
links and a spanning forest of what it linked, so no pairs travel. A graph goes to at most PARTS tasks, so graphs are
shipped in proportion to the input; that every query meets every shard is the method's own cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Sets, bounded, lean, materialize, partitions
from lodestone.llm.components import connected_components

SHARDS = 6
SHARD_BYTES = 128 << 20
BLOCK_ROWS = 25_000
PARTS = 16
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
AUDIT = 48
SAMPLE = 256
RECALL = 0.995
SLACK = 0.02  # a beam is wide enough where its last vector is this far outside the radius


class Graph:
    """A small-world graph over unit vectors x. Level l holds the rows of members[l]; links[l] their neighbours, -1 for none."""

    def __init__(self, x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.members, self.links = x, members, links

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 42) -> Graph:
        """Insert rows in growing batches: each batch searches the graph of all earlier ones and its own batch."""
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(degree)).astype(int), 4)
        level[0] = level.max() if n else 0
        members, links = [], []
        for k in range(level.max() + 1 if n else 1):
            rows = np.flatnonzero(level >= k)
            width = 2 * degree if k == 0 else degree
            graph = np.full((len(rows), width), -1, np.int32)
            one = cls(x[rows], [np.arange(len(rows))], [graph])
            done = min(len(rows), 64)
            if done > 1:
                one._join(np.arange(done), np.arange(done)[None, :].repeat(done, 0), width)
            while done < len(rows):
                to = min(len(rows), done + min(512, done))
                new = np.arange(done, to)
                entry = np.unique(np.linspace(0, done - 1, 24).astype(int))
                near, _ = one.search(one.x[new], beam, entry, only=done)
                # each new row also meets those of its batch
                mates = np.argsort(-(one.x[new] @ one.x[new].T), axis=1)[:, : degree + 1] + done
                one._join(new, np.concatenate([near, mates], axis=1), width)
                done = to
            members.append(rows)
            links.append(graph)
        return cls(x, members, links)

    def _join(self, new: np.ndarray, near: np.ndarray, width: int) -> None:
        """Link new rows with the best of near, both ways; a full row keeps its closest links, spread by one far random one."""
        sims = np.einsum("bmd,bd->bm", self.x[np.maximum(near, 0)], self.x[new])
        sims[(near < 0) | (near == new[:, None])] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, : width // 2]
        rows = np.repeat(new, order.shape[1])
        cols = np.take_along_axis(near, order, 1).ravel()
        good = np.take_along_axis(sims, order, 1).ravel() > -np.inf
        rows, cols = rows[good], cols[good]
        src, dst = np.concatenate([rows, cols]), np.concatenate([cols, rows])
        touched = np.unique(src)
        old = self.links[0][touched]
        o_src, o_dst = np.repeat(touched, old.shape[1]), old.ravel()
        keep = o_dst >= 0
        src, dst = np.concatenate([o_src[keep], src]), np.concatenate([o_dst[keep], dst])
        key = np.unique(src * np.int64(len(self.x)) + dst)
        src, dst = key // len(self.x), key % len(self.x)
        sim = np.einsum("id,id->i", self.x[src], self.x[dst])
        order = np.lexsort((dst, -sim, src))
        src, dst = src[order], dst[order]
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        size = np.diff(np.append(heads, len(src)))
        rank = np.arange(len(src)) - np.repeat(heads, size)
        # of a row with too many links, three quarters of the places go to the closest, the others are spread over the rest
        close = width - width // 4
        many = np.repeat(size, size)
        step = np.maximum(1, -(-(many - close) // (width // 4)))
        place = np.where((many <= width) | (rank < close), rank, np.where((rank - close) % step == 0, close + (rank - close) // step, width))
        fits = place < width
        self.links[0][touched] = -1
        self.links[0][src[fits], place[fits]] = dst[fits]

    def search(self, q: np.ndarray, beam: int, entry: np.ndarray, level: int = 0, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the beam of each query on one level, best first, -1 where the beam isn't full."""
        n = len(self.members[level]) if only is None else only
        beam = min(beam, n)
        at_once = max(1, min(512, (64 << 20) // max(n, 1)))
        found = [self._search(q[a : a + at_once], beam, entry if entry.ndim == 1 else entry[a : a + at_once], level, n) for a in range(0, len(q), at_once)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, q, beam, entry, level, n):
        rows, links = self.members[level], self.links[level]
        b = len(q)
        entry = np.broadcast_to(entry, (b, entry.shape[-1]))
        seen = np.zeros((b, n), bool)
        np.put_along_axis(seen, entry, True, 1)
        width = max(beam, entry.shape[1])
        node = np.full((b, width), -1, np.int64)
        sim = np.full((b, width), -np.inf, np.float32)
        fresh = np.zeros((b, width), bool)
        node[:, : entry.shape[1]] = entry
        sim[:, : entry.shape[1]] = np.einsum("bmd,bd->bm", self.x[rows[entry]], q)
        fresh[:, : entry.shape[1]] = True
        order = np.argsort(-sim, axis=1)[:, :beam]
        node, sim, fresh = (np.take_along_axis(v, order, 1) for v in (node, sim, fresh))
        live = np.arange(b)
        expand = 4
        while len(live):
            rank = np.cumsum(fresh[live], axis=1)
            pick = fresh[live] & (rank <= expand)
            some = pick.any(axis=1)
            live, pick = live[some], pick[some]
            if not len(live):
                break
            chosen = np.argsort(~pick, axis=1, kind="stable")[:, :expand]
            ok = np.take_along_axis(pick, chosen, 1)
            base = np.where(ok, node[live[:, None], chosen], -1)
            fresh[live] &= ~pick
            near = np.where(base[:, :, None] >= 0, links[np.maximum(base, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            bad = near < 0
            bad[:, 1:] |= near[:, 1:] == near[:, :-1]
            safe = np.maximum(near, 0)
            bad |= seen[live[:, None], safe]
            where = np.nonzero(~bad)
            seen[live[where[0]], safe[where]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[where] = np.einsum("id,id->i", self.x[rows[safe[where]]], q[live[where[0]]])
            all_node = np.concatenate([node[live], safe], axis=1)
            all_sim = np.concatenate([sim[live], s], axis=1)
            all_fresh = np.concatenate([fresh[live], ~bad], axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            node[live] = np.take_along_axis(all_node, order, 1)
            sim[live] = np.take_along_axis(all_sim, order, 1)
            fresh[live] = np.take_along_axis(all_fresh, order, 1)
        node = np.where(sim > -np.inf, node, -1)
        return node, sim

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam of each query on the lowest level, entered by way of the levels above."""
        top = len(self.members) - 1
        entry = np.arange(min(4, len(self.members[top])))
        for level in range(top, 0, -1):
            best, _ = self.search(q, 8, entry, level)
            inner = np.searchsorted(self.members[level - 1], self.members[level][np.maximum(best[:, :4], 0)])
            entry = inner
        return self.search(q, beam, entry)


def exact_links(x: np.ndarray, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all links, by brute force in blocks of queries and rows."""
    out_q, out_r = [np.zeros(0, int)], [np.zeros(0, int)]
    for a in range(0, len(q), 512):
        for b in range(0, len(x), 16_384):
            i, r = np.nonzero(q[a : a + 512] @ x[b : b + 16_384].T >= radius - 1e-9)
            for at in range(0, len(i), 1 << 18):
                k, m = i[at : at + (1 << 18)] + a, r[at : at + (1 << 18)] + b
                exact = np.einsum("id,id->i", q[k], x[m]) >= radius
                out_q.append(k[exact])
                out_r.append(m[exact])
    return np.concatenate(out_q), np.concatenate(out_r)


def _near(graph: Graph, x: np.ndarray, q: np.ndarray, radius: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all links found; queries whose beam ends inside the radius search again with a beam four times as wide."""
    todo = np.arange(len(q))
    out_q, out_r = [], []
    qf = q.astype(np.float32)
    while len(todo):
        if beam >= len(x):
            i, r = exact_links(x, q[todo], radius)
            out_q.append(todo[i])
            out_r.append(r)
            break
        rows, sims = graph.query(qf[todo], beam)
        full = (rows[:, -1] >= 0) & (sims[:, -1] >= radius - SLACK)
        i, k = np.nonzero((sims >= radius - 1e-4) & (rows >= 0) & ~full[:, None])
        a, b = todo[i], rows[i, k]
        exact = np.einsum("id,id->i", q[a], x[b]) >= radius
        out_q.append(a[exact])
        out_r.append(b[exact])
        todo = todo[full]
        beam *= 4
    return np.concatenate(out_q) if out_q else np.zeros(0, int), np.concatenate(out_r) if out_r else np.zeros(0, int)


def audited_links(graph: Graph, x: np.ndarray, q: np.ndarray, radius: float, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) links, the beam doubled until a brute-force audit of some queries finds the asked recall; a beam as wide as x is exact.

    Audited are a random sample of the block and apart from it audit // 2 queries with the most links found so far. Of each of the two
    the mean of the queries' own recalls must reach the asked one, so that queries with many links can't hide others' misses.
    """
    rng = np.random.default_rng(42)
    drawn = rng.permutation(len(q))[:sample]
    truth = lambda some: np.bincount(exact_links(x, q[some], radius)[0], minlength=len(some))
    true_drawn = truth(drawn)
    while True:
        i, r = _near(graph, x, q, radius, beam)
        if beam >= len(x):
            return i, r
        found = np.bincount(i, minlength=len(q))
        most = np.argsort(-found, kind="stable")[: audit // 2]
        own = lambda some, true: (found[some] / np.maximum(true, 1))[true > 0]
        if all(not len(share) or share.mean() >= recall for share in (own(drawn, true_drawn), own(most, truth(most)))):
            return i, r
        beam *= 2


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by their largest component first, so that no finite row's norm over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _to_blob(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, graph: Graph) -> bytes:
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    if np.array_equal(single.astype(np.float64), vectors):  # half the bytes where nothing is lost
        vectors = single
    parts = [ids, sizes, vectors, *graph.members, *graph.links]
    batch = pa.record_batch([pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([p.dtype.str for p in parts]), pa.array([list(p.shape) for p in parts], pa.list_(pa.int64()))], names=["data", "kind", "shape"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    rows = pa.ipc.open_stream(blob).read_next_batch().to_pylist()
    parts = [np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in rows]
    ids, sizes, vectors = parts[:3]
    levels = (len(parts) - 3) // 2
    x = _unit(vectors.astype(np.float64))
    return ids, sizes, x, Graph(x.astype(np.float32), parts[3 : 3 + levels], parts[3 + levels :])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = 0.9, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and stay alone; so do rows
    with a null id. Any other finite vector counts, however large or small. Vectors of other lengths never link. Equal vectors
    are compared once and count as links of one another. Links join vectors, not ids: where an id stands in rows of different
    vectors, each has its own links and its own component, which is named by the smallest id among its vectors.
    shards is the least number of shards; more are used where a shard's vectors and links would take more than shard_bytes.
    Other columns are not read. An empty table gives an empty table.
    """
    if not 0 < radius <= 1:
        raise ValueError("the radius is a cosine above 0")
    picked = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    marked = picked.withColumn("valid", valid)
    classes = marked.where("valid").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    # the numbers are settled once the table is written
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n, widest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards = max(shards, -(-n * (8 * widest + 8 * DEGREE + 32) // shard_bytes))
    parts = min(PARTS, max(1, -(-n // block_rows)))
    dim = F.size("v").cast("bigint")
    home = dim * shards + F.pmod(F.xxhash64("v"), F.lit(shards))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        rows = _vectors(table.column("v"))
        graph = Graph.build(_unit(rows).astype(np.float32))
        blob = _to_blob(table.column("node").to_numpy(), table.column("size").to_numpy(), rows, graph)
        return pa.table({"shard": table.column("shard")[:1], "graph": pa.array([blob], pa.binary())})

    graphs = materialize(classes.withColumn("shard", home).groupBy("shard").applyInArrow(build, "shard bigint, graph binary"), "graphs")
    none = lambda kind: F.lit(None).cast(kind)
    loads = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), none("bigint").alias("node"), "graph", none("array<double>").alias("v"))
    part = F.pmod(F.xxhash64("v", F.lit(11)), F.lit(parts)).cast("int")
    asked = classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: dim * shards + k)).alias("shard"), part.alias("part"), "node", none("binary").alias("graph"), "v")
    # a graph (node is null) comes before the queries of its shard and part
    dealt = loads.unionByName(asked).repartition(max(partitions(vectors.sparkSession), min(shards * parts, 100_000)), "shard", "part").sortWithinPartitions("shard", "part", F.col("node").asc_nulls_first())

    @lean
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, loaded, held, n_held = None, None, [], 0

        def answer() -> pa.RecordBatch:
            ids, sizes, x, graph = loaded
            nodes_asked = np.concatenate([h[0] for h in held])
            i, r = audited_links(graph, x, _unit(np.concatenate([h[1] for h in held])), radius, recall=recall)
            held.clear()
            other = nodes_asked[i] != ids[r]
            i, r = i[other], r[other]
            n = np.bincount(i, weights=sizes[r], minlength=len(nodes_asked)).astype(np.int64)
            nodes = np.unique(np.concatenate([nodes_asked, ids]))
            sets = Sets(len(nodes))
            sets.union(np.searchsorted(nodes, nodes_asked[i]), np.searchsorted(nodes, ids[r]))
            a, b = sets.links()
            counted = np.flatnonzero(n)
            blank = np.arange(len(counted) + len(a)) < len(counted)
            columns = [np.concatenate([nodes_asked[counted], nodes[a]]), np.concatenate([np.zeros(len(counted), np.int64), nodes[b]]), np.concatenate([n[counted], np.zeros(len(a), np.int64)])]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=blank), pa.array(columns[2])], ["a", "b", "n"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "part")], axis=1)
            is_graph = batch.column("node").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | is_graph[1:] | is_graph[:-1], [True]])) if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                if tuple(keys[lo]) != at:
                    if held and loaded is not None:
                        yield answer()
                    held, n_held, loaded, at = [], 0, None, tuple(keys[lo])
                if is_graph[lo]:
                    loaded = _from_blob(batch.column("graph")[int(lo)].as_py())
                elif loaded is not None:  # no vector of this length lives in the shard otherwise
                    rows = batch.slice(lo, hi - lo)
                    held.append((rows.column("node").to_numpy(zero_copy_only=False).astype(np.int64), _vectors(rows.column("v"))))
                    n_held += hi - lo
                    if n_held >= block_rows:
                        yield answer()
                        n_held = 0
        if held and loaded is not None:
            yield answer()

    found = materialize(bounded(dealt).mapInArrow(ask, "a bigint, b bigint, n bigint"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "member")
    per_class = classes.join(counts, F.col("node") == F.col("a"), "left").join(joined, F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node"))
    named = per_class.groupBy("component").agg(F.min("rep").alias("named"))
    per_class = per_class.join(named, "component").select(F.col("v").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "named")
    out = marked.withColumn("k", F.when(F.col("valid"), F.col("v"))).join(per_class, "k", "left")
    component = F.when(F.col("valid"), F.col("named")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
