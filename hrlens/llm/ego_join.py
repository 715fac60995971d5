"""Operator 1: near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t are at most ``eps = sqrt(2 - 2 t)`` apart, and so are their projections
on any orthonormal directions.  Vectors are projected on the leading principal directions (of the
scatter around the label means, summed over all rows), put on a grid of side ``eps`` and sorted by
label and cells.  The order is cut into intervals of bounded size.  Two intervals are joined only
if their boxes come within ``eps``; a join halves its intervals recursively, skips halves that are
provably distant, and compares the rest exactly in double precision.

A join task hands on link counts and a spanning forest of its links, never all pairs: each linked
vector costs one row.

Defined cases: vectors with a null label, null, empty or zero vectors and vectors with a null or
non-finite component have no links and are their own component; vectors of different lengths never
link; equal vectors are collapsed before the join and counted in full; rows with a null id take
part, and a component's id is its smallest id that is not null; an empty table gives no rows.  Only
the id, vector and label columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import components, staged

DIMS = 8         # leading principal directions of the grid
INTERVAL = 2048  # vectors of one interval
LEAF = 128
HELD = 50_000    # vectors that a task collapses together
SLACK = 1e-9     # rounding allowance when boxes are compared


_ROWS = "uid long, vec_id long, rep long, label string, dim int, m long, vec binary"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows, points equal vectors of one task at the first of them (``rep``), and hands on
    each such vector once, with its copies counted in ``m``; ``m`` is null on the input's rows."""
    uid = TaskContext.get().partitionId() << 33
    held: dict[tuple, list[int]] = {}  # (label, vector) -> number of the first row, copies
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def vectors() -> pa.RecordBatch:
        cols = list(zip(*((rep, None, rep, label, len(raw) // 8, m, raw) for (label, raw), (rep, m) in held.items())))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        reps, start = [], uid
        for v, label in zip(batch["vec"].to_pylist(), batch["label"].to_pylist()):
            rep = uid
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
                if 0.0 < norm < math.inf:
                    entry = held.setdefault((label, x.astype("<f8").tobytes()), [uid, 0])
                    entry[1] += 1
                    rep = entry[0]
            reps.append(rep)
            uid += 1
        n = len(reps)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(start, uid), kinds[0]), batch["vec_id"], pa.array(reps, kinds[2]), *(pa.nulls(n, k) for k in kinds[3:])], names=names)
        if len(held) > HELD:
            yield vectors()
    if held:
        yield vectors()


def _units(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _rows_of(matrix: np.ndarray, dim: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([dim] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))],
        names=["dim", "i", "row"])


def _second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims, vecs = batch["dim"].to_numpy(zero_copy_only=False), batch["vec"].to_pylist()
        for d in np.unique(dims).tolist():
            x = _units([v for v, k in zip(vecs, dims) if k == d])
            total[d] = total.get(d, 0.0) + x.T @ x
    for d, m in total.items():
        yield _rows_of(m, d)


def _label_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = list(zip(batch["label"].to_pylist(), batch["dim"].to_pylist()))
        vecs = batch["vec"].to_pylist()
        out = []
        for key in dict.fromkeys(keys):
            x = _units([v for v, k in zip(vecs, keys) if k == key])
            out.append((*key, len(x), x.sum(0)))
        if out:
            label, dim, n, total = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.string()), pa.array(dim, pa.int32()), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["label", "dim", "n", "total"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, n, s in zip(batch["dim"].to_pylist(), batch["n"].to_pylist(), batch["total"].to_pylist()):
            s = np.array(s)
            total[d] = total.get(d, 0.0) - np.outer(s, s) / n
    for d, m in total.items():
        yield _rows_of(m, d)


def principal_directions(reps: DataFrame) -> dict[int, np.ndarray]:
    """Vector length -> leading directions of the scatter within labels, over all rows.

    The driver gets one square matrix per vector length, whatever the number of rows.
    """
    sums = (reps.mapInArrow(_label_sums, "label string, dim int, n long, total array<double>")
            .select("label", "dim", "n", F.posexplode("total").alias("j", "x"))
            .groupBy("label", "dim", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
            .groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "x")))["x"].alias("total")))
    schema = "dim int, i int, row array<double>"
    cells = (reps.mapInArrow(_second_moments, schema).unionByName(
        sums.select("dim", "n", "total").mapInArrow(_between, schema))
        .select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")))
    found: dict[int, np.ndarray] = {}
    table = cells.toArrow()
    dims, i, j, x = (table[c].to_numpy() for c in ("dim", "i", "j", "x"))
    for d in np.unique(dims).tolist():
        m = np.zeros((d, d))
        m[i[dims == d], j[dims == d]] = x[dims == d]
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        found[d] = vectors[:, ::-1][:, :DIMS].copy()
    return found


def _place(basis: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs = batch["dim"].to_numpy(zero_copy_only=False), batch["vec"].to_pylist()
            cells = np.zeros((len(vecs), DIMS), np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                y = _units([vecs[i] for i in at]) @ basis[d]
                cells[at, :y.shape[1]] = np.floor(y / eps)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("uid", "label", "dim", "m", "vec")] + [pa.array(cells[:, k]) for k in range(DIMS)],
                names=["uid", "label", "dim", "m", "vec", *(f"c{k}" for k in range(DIMS))])
    return run


def _intervals(basis: dict[int, np.ndarray]):
    names = ["block", "label", "dim", "lo", "hi", "uids", "ms", "vecs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal block, held
            label, dim = held[0][:2]
            vecs = [h[4] for h in held]
            y = _units(vecs) @ basis[dim]
            row = [[block], [label], [dim], [y.min(0)], [y.max(0)], [np.array([h[2] for h in held], "<i8").tobytes()],
                   [np.array([h[3] for h in held], "<i8").tobytes()], [b"".join(vecs)]]
            block, held = block + 1, []
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)

        for batch in batches:
            for x in zip(*(batch[c].to_pylist() for c in ("label", "dim", "uid", "m", "vec"))):
                if held and (len(held) == INTERVAL or held[0][:2] != x[:2]):
                    yield close()
                held.append(x)
        if held:
            yield close()
    return run


class _Join:
    """Recursive join of two intervals; ``same`` if they are one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, mx, my, least: float, same: bool) -> None:
        self.x, self.y, self.px, self.py, self.mx, self.my, self.least, self.same = x, y, px, py, mx, my, least, same
        self.reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
        self.links = np.zeros(len(x) + (0 if same else len(y)), np.int64)
        self.tree = np.arange(len(self.links))
        self.base = 0 if same else len(x)
        self._visit(0, len(x), 0, len(y))

    def _far(self, a: int, b: int, c: int, d: int) -> bool:
        lo = np.maximum(self.px[a:b].min(0), self.py[c:d].min(0))
        hi = np.minimum(self.px[a:b].max(0), self.py[c:d].max(0))
        gap = np.maximum(lo - hi, 0)
        return float(gap @ gap) > self.reach ** 2

    def _visit(self, a: int, b: int, c: int, d: int) -> None:
        if self.same and d <= a or a >= b or c >= d or self._far(a, b, c, d):
            return
        if b - a <= LEAF and d - c <= LEAF:
            self._compare(a, b, c, d)
        elif b - a >= d - c:
            mid = (a + b) // 2
            self._visit(a, mid, c, d)
            self._visit(mid, b, c, d)
        else:
            mid = (c + d) // 2
            self._visit(a, b, c, mid)
            self._visit(a, b, mid, d)

    def _compare(self, a: int, b: int, c: int, d: int) -> None:
        near = self.x[a:b] @ self.y[c:d].T >= self.least
        if self.same:
            near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not near.any():
            return
        self.links[a:b] += near @ self.my[c:d]
        self.links[self.base + c:self.base + d] += self.mx[a:b] @ near
        for i in np.flatnonzero(near.any(1)):
            joined = self.tree[self.base + c + np.flatnonzero(near[i])]
            own = self.tree[a + i]
            if (joined != own).any():
                every = np.unique(np.append(joined, own))
                self.tree[np.isin(self.tree, every)] = every[0]


def _link(basis: dict[int, np.ndarray], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                side = {}
                for k in "ab":
                    raw = np.frombuffer(r[f"vecs_{k}"], "<f8").reshape(-1, r["dim"])
                    unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
                    side[k] = (unit, unit @ basis[r["dim"]], np.frombuffer(r[f"ms_{k}"], "<i8"), np.frombuffer(r[f"uids_{k}"], "<i8"))
                (x, px, mx, ux), (y, py, my, uy) = side["a"], side["b"]
                j = _Join(x, y, px, py, mx, my, least, same)
                uids = ux if same else np.concatenate((ux, uy))
                hit = np.flatnonzero(j.links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uids[hit]), pa.array(j.links[hit]), pa.array(uids[j.tree[hit]])], names=["uid", "links", "mate"])
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    eps = math.sqrt(2 - 2 * least)
    table = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                                  F.col(label_col).cast("string").alias("label"))
                   .mapInArrow(_collapse, _ROWS), "ego-rows")
    reps = table.filter("m is not null").select("uid", "label", "dim", "m", "vec")
    basis = principal_directions(reps)
    order = ["label", "dim", *(f"c{k}" for k in range(DIMS)), "uid"]
    placed = reps.mapInArrow(
        _place(basis, eps), "uid long, label string, dim int, m long, vec binary, " + ", ".join(f"c{k} int" for k in range(DIMS)))
    blocks = staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _intervals(basis), "block long, label string, dim int, lo array<double>, hi array<double>, uids binary, ms binary, vecs binary"),
        "ego-intervals")
    span = lambda lo, hi, more: F.sequence(F.floor((F.col(lo)[0] - more) / eps), F.floor((F.col(hi)[0] + more) / eps))
    left = blocks.select("label", "dim", F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                         F.explode(span("lo", "hi", 0.0)).alias("cell"))
    right = blocks.select("label", "dim", F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                          F.explode(span("lo", "hi", eps + SLACK)).alias("cell"))
    gap = F.aggregate(
        F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
                   lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    # a pair of intervals is met in several cells and counts in the first of them
    first = F.greatest(F.floor(F.col("lo_a")[0] / eps), F.floor((F.col("lo_b")[0] - eps - SLACK) / eps))
    near = (left.join(right, ["label", "dim", "cell"])
            .filter((F.col("a") <= F.col("b")) & (F.col("cell") == first) & (gap <= (eps + SLACK) ** 2)).select("a", "b", "dim"))
    load = lambda k: blocks.select(F.col("block").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("uids", "ms", "vecs")])
    found = staged(near.join(load("a"), "a").join(load("b"), "b")
                   .mapInArrow(_link(basis, least), "uid long, links long, mate long"), "ego-links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("mate").alias("b")), "ego-cc")
    facts = reps.select(F.col("uid").alias("rep"), "m").join(links.withColumnRenamed("uid", "rep"), "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    rows = table.filter("m is null").select("vec_id", "rep").join(facts, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    smallest = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return rows.join(smallest, "root").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
