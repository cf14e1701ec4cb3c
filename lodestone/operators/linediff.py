"""Line diffs: patience matching of two line sequences, and what follows from its edit script."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unique_matches(a: list[str], b: list[str], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """The longest run, ascending on both sides, of lines that stand once on each."""
    in_a, in_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    where = {b[j]: j for j in range(lo_b, hi_b) if in_b[b[j]] == 1}
    pairs = [(i, where[a[i]]) for i in range(lo_a, hi_a) if in_a[a[i]] == 1 and a[i] in where]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def line_diff(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Edit script [(op, index in a, index in b)], op keep, delete or add, -1 for no line.

    Equal heads and tails are kept, then lines unique on both sides anchor the rest; between anchors without any, lines are
    deleted, then added. Keeps and deletes give a, keeps and adds give b.
    """
    out: list[tuple[str, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        if lo_a < 0:  # a kept run: (-1 - first, its end, first in b, -)
            out += [("keep", i, i - (-1 - lo_a) + lo_b) for i in range(-1 - lo_a, hi_a)]
            continue
        head = 0
        while lo_a + head < hi_a and lo_b + head < hi_b and a[lo_a + head] == b[lo_b + head]:
            head += 1
        out += [("keep", lo_a + k, lo_b + k) for k in range(head)]
        lo_a, lo_b = lo_a + head, lo_b + head
        tail = 0
        while hi_a - tail > lo_a and hi_b - tail > lo_b and a[hi_a - tail - 1] == b[hi_b - tail - 1]:
            tail += 1
        hi_a, hi_b = hi_a - tail, hi_b - tail
        later = [(-1 - hi_a, hi_a + tail, hi_b, 0)] if tail else []
        anchors = _unique_matches(a, b, lo_a, hi_a, lo_b, hi_b)
        if anchors:
            at_a, at_b, parts = lo_a, lo_b, []
            for i, j in anchors:
                parts += [(at_a, i, at_b, j), (-1 - i, i + 1, j, 0)]
                at_a, at_b = i + 1, j + 1
            parts.append((at_a, hi_a, at_b, hi_b))
            todo += (parts + later)[::-1]
        else:
            out += [("delete", i, -1) for i in range(lo_a, hi_a)] + [("add", -1, j) for j in range(lo_b, hi_b)]
            todo += later
    return out


def modified_runs(script: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(deleted, added) pairs: the k-th delete and the k-th add of every run of deletes that adds follow."""
    out, deletes, adds = [], [], []
    for op, i, j in [*script, ("keep", -1, -1)]:
        if op == "keep" or (op == "delete" and adds):
            out += list(zip(deletes, adds))
            deletes, adds = [], []
        if op == "delete":
            deletes.append(i)
        elif op == "add":
            adds.append(j)
    return out


def diff_stats(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with kept, deleted, added, modified line counts of two text columns. Null texts have no lines."""
    names = pairs.columns

    def lines(text: str | None) -> list[str]:
        return (text or "").split("\n")[: -1 if (text or "").endswith("\n") or not text else None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for a, b in zip(batch.column(old).to_pylist(), batch.column(new).to_pylist()):
                script = line_diff(lines(a), lines(b))
                ops = Counter(op for op, _, _ in script)
                counts.append((ops["keep"], ops["delete"], ops["add"], len(modified_runs(script))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))], [*names, "kept", "deleted", "added", "modified"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", kept bigint, deleted bigint, added bigint, modified bigint"
    return pairs.select(*[F.col(c) for c in names]).mapInArrow(run, schema)
