"""Trees, forests and boosting grown level by level from histogram tables.

Rows are binned once into a written table (one byte a feature).  A level of many trees, of all
candidates and folds together, is one job: every task adds up its rows per (tree, node) into one
histogram over the features' bins, the histograms of a node meet in one task, and that task returns the
node's best split.  The driver holds the trees (their size follows from depth and number, not from the
rows) and hands them to the next level's job; a lost executor costs its part of one level.

* Trees and forests split by weighted Gini impurity; a node with fewer than ``min_split`` rows is
  not split, a child keeps ``min_leaf`` rows at least (rows are counted without weights).  Forests draw
  Poisson(1) row weights and, per node, the columns to look at, both by hash.  Where a level's histograms
  would need more than one pass, nodes of at most ``SMALL`` rows wait, in single trees always those of at most ``SINGLE``; in the end their
  rows are sent to tasks that grow them to the end, so the number of passes does not grow with the number of
  nodes.  A search over single trees has the held-out rows sent along and scored there: what grows below a
  waiting node never reaches the driver.
* Boosting is second order on the logistic loss: gain and leaf values from sums of gradients and
  Hessians with an L2 term, one column sample and one row sample per tree by hash, weight on positives.
* One grown ensemble holds many candidates: fewer trees, less depth and (for independent trees) a
  larger minimum split are cuts of it, because a node's split depends on its own rows and its place
  only.  ``held_out_scores`` evaluates all cuts in one pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .logistic import matrix

BINS = 64                 # at most so many bins a feature (256 fit a byte)
CELLS = 4_000_000         # histogram cells that a task holds in one pass
SMALL = 4096              # rows of a node that one task may grow to the end
SINGLE = 1 << 17          # the same in an ensemble of one tree
PART = 1 << 17            # histogram cells of the nodes that are split at once there
BLOCK = 1 << 14           # rows that a forest's level takes at once: its temporaries stay in a core's cache
GROUP = 16                # blocks that one tree takes before the next one: its sums stay there, too
COUNT = float(1 << 26)    # in a forest's sums: one row, beside the times that it was drawn
FLUSH = 1 << 22           # rows after which a task hands over a forest's sums (they are exact until then)
JOINT = 256               # cells of several columns that are summed as one
POINTS = 1 << 12          # values of a column that stand for up to ``SUMMED`` rows
SUMMED = 1 << 16
MARGIN_ROUNDS = 4         # boosting rounds between two writings of the margins
FLAT = 1e-12
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
_POISSON_53 = np.ceil(_POISSON * float(1 << 53)).astype(np.uint64)
# draws by the upper 16 of the 53 bits; 255: a border lies inside
_POISSON_16 = np.searchsorted(_POISSON_53, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), side="right").astype(np.uint8)
_POISSON_16[(_POISSON_53 >> np.uint64(37))[_POISSON_53 < np.uint64(1 << 53)].astype(np.intp)] = 255


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for row and column draws."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) by hash of key and seed."""
    return (scramble(keys.astype(np.uint64) + scramble(np.array([seed], np.int64).view(np.uint64))) >> np.uint64(11)) / float(1 << 53)


@dataclass(frozen=True)
class Ensemble:
    """What to grow.  ``fold``: rows of this fold are held out, and ``x{fold}`` are the features.
    ``columns``: for independent trees the number of columns a node looks at, for boosting the share of
    columns of a tree (None: all).  ``rows``: "poisson", a share, or None for all."""
    kind: str                      # "gini" or "logistic"
    fold: int
    weights: tuple[float, float] = (1.0, 1.0)
    trees: int = 1
    depth: int = 30
    min_split: int = 2
    min_leaf: int = 1
    columns: float | int | None = None
    rows: float | str | None = None
    rate: float = 0.3
    l2: float = 1.0
    min_hessian: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` is -1 in a leaf, the right child follows the left one."""
    of: int
    number: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    place: list[int] = field(default_factory=lambda: [1])   # root 1, children 2p and 2p + 1
    stats: list[tuple[float, float, int]] = field(default_factory=lambda: [(0.0, 0.0, 0)])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def arrays(self, e: Ensemble) -> dict[str, np.ndarray]:
        s = np.array(self.stats, float).reshape(-1, 3)
        if e.kind == "gini":
            total = s[:, 0] + s[:, 1]
            value = np.divide(s[:, 1], total, out=np.zeros(len(s)), where=total > 0)
        else:
            value = -e.rate * s[:, 0] / (s[:, 1] + e.l2)
        return {"feature": np.array(self.feature, np.int32), "cut": np.array(self.cut, np.int32), "left": np.array(self.left, np.int32),
                "depth": np.array(self.depth, np.int32), "n": s[:, 2], "value": value}


# ---------------------------------------------------------------- binned table

def borders(rows: DataFrame, columns: Sequence[str], sizes: dict[str, int], bins: int = BINS) -> dict[str, list[list[float]]]:
    """Upper borders of the bins of each entry of the array columns: values of the data, at most
    ``bins - 1``; ``x <= border`` goes left.  One aggregate; a column's own fold is left out."""
    grid = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    aggs = [F.expr(f"percentile_approx({c}[{j}], array({grid}), {20 * bins}) FILTER (WHERE fold <> {int(c[1:])})").alias(f"{c}_{j}")
            for c in columns for j in range(sizes[c])]
    tops = [F.expr(f"max({c}[{j}]) FILTER (WHERE fold <> {int(c[1:])})").alias(f"{c}_{j}_top") for c in columns for j in range(sizes[c])]
    got = rows.agg(*aggs, *tops).first()
    return {c: [sorted({v for v in got[f"{c}_{j}"] or [] if v < got[f"{c}_{j}_top"]}) for j in range(sizes[c])] for c in columns}


def _summary(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most some ``POINTS`` of the distinct ``values``, in order, each with the rows up to it; the last is kept."""
    order = np.argsort(values, kind="stable")
    v, upto = values[order], np.cumsum(rows[order])
    last = np.flatnonzero(np.append(v[1:] != v[:-1], True)) if len(v) else np.zeros(0, np.intp)
    v, upto = v[last], upto[last]
    if len(v) > POINTS:
        chunk = (upto * POINTS - 1) // upto[-1]
        kept = np.flatnonzero(np.append(chunk[1:] != chunk[:-1], True))
        v, upto = v[kept], upto[kept]
    return v, np.diff(upto, prepend=0)


def ranked_borders(rows: DataFrame, sizes: dict[str, int], bins: int = BINS) -> dict[str, list[list[float]]]:
    """``borders`` for many array columns (by name: their size): tasks sort the values of some rows and hand over a summary,
    one task per column merges its summaries.  Exact up to ``POINTS`` distinct values in ``SUMMED`` rows, else
    within 1 / ``POINTS`` of the rows; the same for the same partitions."""
    names = list(sizes)
    schema = "col int, entry int, v binary, n binary"

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                          names=["col", "entry", "v", "n"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, SUMMED):
            fold, out = batch["fold"].to_numpy(zero_copy_only=False), []
            for i, c in enumerate(names):
                x = np.ascontiguousarray(matrix(batch[c])[fold != int(c[1:])].T)
                for j, values in enumerate(x if len(batch) else ()):
                    v, n = _summary(values, np.ones(len(values), np.int64))
                    if len(v):
                        out.append((i, j, v.astype(float).tobytes(), n.astype(np.int64).tobytes()))
            yield batch_of(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault((r["col"], r["entry"]), []).append((r["v"], r["n"]))
        out = []
        for (i, j), parts in held.items():
            values, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*parts), (float, np.int64)))
            order = np.argsort(values, kind="stable")
            values, upto = values[order], np.cumsum(n[order])
            ranks = [-(-k * int(upto[-1]) // bins) for k in range(1, bins)]
            at = values[np.searchsorted(upto, ranks, side="left")]
            out.append((i, j, np.unique(at[at < values[-1]]).tobytes(), b""))
        yield batch_of(out)

    got = (rows.select("fold", *names).mapInArrow(summarise, schema).repartition(rows.sparkSession.sparkContext.defaultParallelism, "col", "entry")
           .mapInArrow(merge, schema).collect())
    out: dict[str, list[list[float]]] = {c: [[] for _ in range(n)] for c, n in sizes.items()}
    for r in got:
        out[names[r["col"]]][r["entry"]] = np.frombuffer(r["v"]).tolist()
    return out


def _bin(edges: dict[str, list[list[float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch["h"], batch["y"], batch["fold"]]
            for c, cuts in edges.items():
                x = matrix(batch[c])
                b = np.empty(x.shape, np.uint8)
                for j, e in enumerate(cuts):
                    b[:, j] = np.searchsorted(np.array(e), x[:, j], side="left")
                out.append(pa.array([r.tobytes() for r in b], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["h", "y", "fold", *edges])
    return run


@dataclass
class Binned:
    """The written table ``h`` (hash of the row's key), ``y, fold`` and bins ``x{fold}``, with its borders."""
    rows: DataFrame
    edges: dict[str, list[list[float]]]

    def layout(self, fold: int) -> np.ndarray:
        """First cell of each feature in a node's histogram, and the end."""
        return np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges[f"x{fold}"]]))).astype(np.int64)


def binned(rows: DataFrame, columns: Sequence[str], bins: int = BINS, edges: dict | None = None) -> Binned:
    """``rows``: ``h, y, fold`` and array<double> columns named ``x{fold}``."""
    if not edges:
        first = rows.first()
        edges = borders(rows, columns, {c: len(first[c]) for c in columns}, bins)
    schema = "h long, y int, fold int, " + ", ".join(f"{c} binary" for c in columns)
    return Binned(cut_lineage(rows.select("h", "y", "fold", *columns).mapInArrow(_bin(edges), schema)), edges)


# ---------------------------------------------------------------- one level

def _walk(t: dict[str, np.ndarray], x: np.ndarray, depth: int | None = None, min_split: int = 0) -> np.ndarray:
    """The node in which each row ends, stopping at ``depth`` and in nodes of fewer than ``min_split`` rows."""
    at = np.zeros(len(x), np.int32)
    go = t["feature"] >= 0
    if depth is not None:
        go = go & (t["depth"] < depth)
    go = go & (t["n"] >= min_split) if min_split else go
    moving = np.flatnonzero(go[at])
    while len(moving):
        a = at[moving]
        at[moving] = t["left"][a] + (x[moving, t["feature"][a]] > t["cut"][a])
        moving = moving[go[at[moving]]]
    return at


def _columns_of_nodes(e: Ensemble, tree: int, places: Sequence[int], d: int) -> list[np.ndarray]:
    """``_columns_of`` of many nodes of a forest's tree."""
    key = np.arange(d, dtype=np.uint64)[None, :] + scramble(np.array(places, np.uint64))[:, None] + np.uint64(1)
    m = max(1, min(d, int(e.columns)))
    return list(np.sort(np.argsort(uniform(key, e.seed * 1_000_003 + tree), axis=1, kind="stable")[:, :m], axis=1))


def _columns_of(e: Ensemble, tree: int, place: int, d: int) -> np.ndarray:
    """Columns that a node (boosting: a tree) may split on."""
    if e.columns is None:
        return np.arange(d)
    m = max(1, int(e.columns * d)) if e.kind == "logistic" else max(1, min(d, int(e.columns)))
    key = np.arange(d, dtype=np.uint64) + scramble(np.array([place if e.kind == "gini" else 0], np.uint64)) + np.uint64(1)
    return np.sort(np.argsort(uniform(key, e.seed * 1_000_003 + tree), kind="stable")[:m])


def _drawn(e: Ensemble, tree: int, h: np.ndarray) -> np.ndarray:
    """Times that each row counts in a tree."""
    if e.rows is None:
        return np.ones(len(h))
    if e.rows == "poisson":
        return _poisson(e, tree, h).astype(float)
    return (uniform(h.view(np.uint64), e.seed * 7_919 + tree) < e.rows).astype(float)


def _poisson(e: Ensemble, tree: int, h: np.ndarray) -> np.ndarray:
    """Poisson(1) draws: the number of borders that ``uniform`` reaches, compared as whole numbers.  Most rows
    are settled by their upper bits."""
    x = h.view(np.uint64) + scramble(np.array([e.seed * 7_919 + tree], np.int64).view(np.uint64))
    for shift, times in ((30, _M1), (27, _M2)):           # ``scramble`` in place
        x ^= x >> np.uint64(shift)
        x *= times
    x ^= x >> np.uint64(31)
    drawn = _POISSON_16.take((x >> np.uint64(48)).view(np.int64))
    near = np.flatnonzero(drawn == 255)
    if len(near):
        drawn[near] = np.searchsorted(_POISSON_53, x[near] >> np.uint64(11), side="right")
    return drawn


class _Paths:
    """Where rows end in a tree, for all rows of a block step by step."""

    def __init__(self, t: dict[str, np.ndarray]) -> None:
        inner = t["feature"] >= 0
        self.feature = np.where(inner, t["feature"], 0).astype(np.intp)
        self.cut = np.where(inner, t["cut"], 255).astype(np.uint8)               # nothing is above: a leaf keeps its rows
        self.left = np.where(inner, t["left"], np.arange(len(inner))).astype(np.intp)
        self.steps = int(t["depth"].max())

    def ends(self, xf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """``xf``: bins of the rows one after the other; ``off``: where the rows start."""
        at = np.zeros(len(off), np.intp)
        for step in range(self.steps):
            i = self.feature.take(at) if step else np.full(len(off), self.feature[0])
            i += off
            above = xf.take(i) > self.cut.take(at)
            at = self.left.take(at)
            at += above
        return at


class _Block:
    """The rows of a packed block with what the trees of a pass ask for, each worked out once."""

    def __init__(self, block: dict, ensembles: list[Ensemble], grown: list[list[tuple[_Paths, np.ndarray]]]) -> None:
        self.block, self.ensembles, self.grown = block, ensembles, grown
        self.h, self.fold = np.frombuffer(block["h"], np.int64), np.frombuffer(block["fold"], np.int32)
        self.y = (np.frombuffer(block["y"], np.int32) == 1).astype(np.intp)
        self.start = np.frombuffer(block["margin"], float).reshape(len(ensembles), -1) if "margin" in block else None
        self._x: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._columns: dict[int, np.ndarray] = {}
        self._joint: dict[tuple, list[np.ndarray]] = {}
        self._times: dict[tuple, np.ndarray] = {}
        self._margin: dict[int, np.ndarray] = {}

    def x(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins of the rows one after the other, and where each row starts."""
        if fold not in self._x:
            xf = np.frombuffer(self.block[f"x{fold}"], np.uint8)
            self._x[fold] = xf, np.arange(len(self.y)) * (len(xf) // max(1, len(self.y)))
        return self._x[fold]

    def columns(self, fold: int) -> np.ndarray:
        """Column x row."""
        if fold not in self._columns:
            self._columns[fold] = np.ascontiguousarray(self.x(fold)[0].reshape(len(self.y), -1).T)
        return self._columns[fold]

    def joint(self, fold: int, groups: tuple) -> list[np.ndarray]:
        """The cell of each row in each group of columns (their places and strides)."""
        if (fold, groups) not in self._joint:
            x = self.columns(fold)
            self._joint[fold, groups] = [sum((x[j].astype(np.intp) * stride for j, stride in own[1:]), x[own[0][0]].astype(np.intp)) for own in groups]
        return self._joint[fold, groups]

    def margin(self, k: int) -> np.ndarray:
        """Margin of every row under the trees of boosted ensemble ``k`` that are grown."""
        if k not in self._margin:
            m = np.zeros(len(self.y)) if self.start is None else self.start[k].copy()
            for paths, value in self.grown[k]:
                m += value.take(paths.ends(*self.x(self.ensembles[k].fold)))
            self._margin[k] = m
        return self._margin[k]

    def times(self, k: int, tree: int) -> np.ndarray:
        """Times that each row counts in a tree; 0 for the rows of the ensemble's own fold."""
        e = self.ensembles[k]
        key = (e.fold, e.rows, e.rows and e.seed, e.rows and tree)
        if key not in self._times:
            inside = self.fold != e.fold
            self._times[key] = inside.astype(np.uint8) if e.rows is None else (_drawn(e, tree, self.h) * inside).astype(np.uint8)
        return self._times[key]


def _with_paths(grown: list[list[dict]]) -> list[list[tuple[_Paths, np.ndarray]]]:
    return [[(_Paths(t), t["value"]) for t in ts] for ts in grown]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches joined or cut to some ``rows`` rows each."""
    held, n = [], 0

    def joined() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).combine_chunks().to_batches(-(-n // max(1, round(n / rows))))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from joined()
            held, n = [], 0
    if n:
        yield from joined()


def _is_forest(e: Ensemble) -> bool:
    """Nodes with columns of their own: only these columns' cells are summed."""
    return e.kind == "gini" and e.columns is not None


class _ForestSums:
    """Sums of a forest tree's open nodes over the columns that each looks at, in a task.  A cell holds the
    times that rows were drawn plus ``COUNT`` a row, per class; the class weights come in at the end."""

    def __init__(self, first: np.ndarray, t: dict[str, np.ndarray], open_nodes: np.ndarray, looks: list[np.ndarray]) -> None:
        self.paths = _Paths(t)
        self.paths.steps = int(t["depth"][open_nodes].max())
        self.slot = np.full(len(t["feature"]), -1, np.intp)
        self.slot[open_nodes] = np.arange(len(open_nodes))
        self.cols = np.stack(looks).T.astype(np.intp)                            # look x node
        self.width = np.diff(first)[self.cols]
        self.room = max(int(self.width.max(initial=1)), 1)                       # cells of a column in the sums
        self.total = [np.zeros(2 * self.room * len(open_nodes)) for _ in self.cols]

    def add(self, xf: np.ndarray, d: int, times: np.ndarray, y: np.ndarray) -> None:
        """``xf``: bins of the rows one after the other."""
        rows = np.flatnonzero(times)
        off = rows * d
        slot = self.slot.take(self.paths.ends(xf, off))
        if slot.min(initial=0) < 0:
            use = np.flatnonzero(slot >= 0)
            rows, off, slot = rows[use], off[use], slot[use]
        weight = times.take(rows) + COUNT
        key = 2 * slot
        key += y.take(rows)
        key *= self.room
        for cols, total in zip(self.cols, self.total):
            i = cols.take(slot)
            i += off
            np.add.at(total, np.add(key, xf.take(i), out=i), weight)

    def take(self, e: Ensemble) -> tuple[list[int], list[bytes]]:
        """Places in the open nodes of those with rows, and their cells x 3; the sums start anew."""
        nodes = np.arange(self.cols.shape[1])
        packed = np.stack(self.total).reshape(len(self.cols), len(nodes), 2, self.room).transpose(1, 0, 2, 3)   # node x look x class x cell
        count = np.floor(packed / COUNT)
        times = packed - COUNT * count
        own = np.arange(self.room) < self.width.T[:, :, None]
        cells = np.stack((e.weights[0] * times[:, :, 0][own], e.weights[1] * times[:, :, 1][own], count.sum(2)[own]), 1)
        ends = np.cumsum(self.width.sum(0))
        found = np.add.reduceat(cells[:, 2], ends - self.width.sum(0)) > 0
        for t in self.total:
            t[:] = 0
        return nodes[found].tolist(), [cells[z - n:z].tobytes() for z, n in zip(ends[found], self.width.sum(0)[found])]


def _forest_histograms(ensembles, layouts, trees):
    """As ``_histograms`` over ``_packed`` rows, for trees whose nodes have columns of their own: cells of these
    columns only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_ForestSums(layouts[k], t, open_nodes, looks) for k, _, t, open_nodes, looks in trees]

        def taken() -> Iterator[pa.RecordBatch]:
            for i, (s, (k, *_)) in enumerate(zip(sums, trees)):
                nodes, cells = s.take(ensembles[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), i, np.int32)), pa.array(nodes, pa.int32()),
                                                  pa.array(cells, pa.binary())], names=["tree", "node", "cells"])

        def add(blocks: list[dict]) -> None:
            plain = [[np.frombuffer(b[c], kind) for b in blocks] for c, kind in (("h", np.int64), ("y", np.int32), ("fold", np.int32))]
            h, y, fold = plain[0], [(v == 1).astype(np.intp) for v in plain[1]], plain[2]
            x = {f: [np.frombuffer(b[f"x{f}"], np.uint8) for b in blocks] for f in {ensembles[k].fold for k, *_ in trees}}
            for s, (k, number, *_) in zip(sums, trees):
                e = ensembles[k]
                for j in range(len(blocks)):
                    times = _poisson(e, number, h[j]) if e.rows == "poisson" else _drawn(e, number, h[j]).astype(np.uint8)
                    times *= fold[j] != e.fold
                    s.add(x[e.fold][j], len(layouts[k]) - 1, times, y[j])

        n, held = 0, []
        for batch in batches:
            for block in batch.to_pylist():
                held.append(block)
                n += len(block["y"]) // 4
                if len(held) == GROUP or n >= FLUSH:
                    add(held)
                    held = []
                    if n >= FLUSH:
                        yield from taken()
                        n = 0
        if held:
            add(held)
        if n:
            yield from taken()
    return run


class _TreeSums:
    """Sums of a tree's open nodes over the tree's columns, in a task: rows and times per class for Gini, gradients,
    Hessians and rows for boosting.  Columns of few bins are summed together, by the cells of their combinations;
    the last node is for rows of no open node."""

    def __init__(self, e: Ensemble, first: np.ndarray, t: dict[str, np.ndarray], open_nodes: np.ndarray, cols: np.ndarray) -> None:
        self.e, self.first, self.cols, self.nodes = e, first, cols, len(open_nodes)
        self.paths = _Paths(t)
        self.paths.steps = int(t["depth"][open_nodes].max())
        self.slot = np.full(len(t["feature"]), self.nodes, np.intp)
        self.slot[open_nodes] = np.arange(self.nodes)
        groups: list[list[tuple[int, int]]] = []
        self.size: list[int] = []                              # cells of a group
        for j in sorted(cols.tolist(), key=lambda j: first[j + 1] - first[j]):
            w = int(first[j + 1] - first[j])
            if groups and self.size[-1] * w <= JOINT and self.nodes <= 32:      # with many nodes taking them apart costs more
                groups[-1].append((j, self.size[-1]))
                self.size[-1] *= w
            else:
                groups.append([(j, 1)])
                self.size.append(w)
        self.groups = tuple(map(tuple, groups))
        # Gini: class 0 and 1 by rows, and by times where these differ; boosting: three sums
        self.kinds = 3 if e.kind == "logistic" else 2 if e.rows is None else 4
        self.total = [np.zeros((self.kinds, (self.nodes + 1) * w)) for w in self.size]

    def add(self, b: _Block, k: int, number: int) -> None:
        e, times = self.e, b.times(k, number)
        slot = self.slot.take(self.paths.ends(*b.x(e.fold)))
        np.putmask(slot, times == 0, self.nodes)
        x, y, use = b.joint(e.fold, self.groups), b.y, None
        if np.count_nonzero(slot < self.nodes) < 0.6 * len(slot):
            use = np.flatnonzero(slot < self.nodes)
            slot, y, times = slot[use], y[use], times[use]
        if e.kind == "logistic":
            margin = b.margin(k) if use is None else b.margin(k)[use]
            w = times * np.where(y == 1, e.weights[1], e.weights[0])
            p = 1.0 / (1.0 + np.exp(-margin))
            sums = (w * (p - y), np.maximum(w * p * (1 - p), 1e-16), None)
        else:
            slot, sums = 2 * slot + y, (None,) if e.rows is None else (None, times.astype(float))
        for own, w, total in zip(x, self.size, self.total):
            i = slot * w
            i += own if use is None else own.take(use)
            parts = total if e.kind == "logistic" else total.reshape(len(sums), -1)
            for part, v in zip(parts, sums):
                part += np.bincount(i, v, len(part))

    def cells(self) -> np.ndarray:
        """Node x cell x 3, other columns' cells being empty."""
        e, out = self.e, np.zeros((self.nodes, int(self.first[-1]), 3))
        for own, size, total in zip(self.groups, self.size, self.total):
            if e.kind == "logistic":
                sums = total.reshape(3, self.nodes + 1, size)[:, :-1].transpose(1, 0, 2)
            else:
                by_class = total.reshape(self.kinds // 2, self.nodes + 1, 2, size)[:, :-1]
                sums = np.stack((e.weights[0] * by_class[-1, :, 0], e.weights[1] * by_class[-1, :, 1], by_class[0].sum(1)), 1)
            for j, stride in own:
                w = int(self.first[j + 1] - self.first[j])
                out[:, self.first[j]:self.first[j + 1]] = sums.reshape(self.nodes, 3, -1, w, stride).sum((2, 4)).transpose(0, 2, 1)
        return out


def packed(table: Binned, folds: Sequence[int]) -> DataFrame:
    """The rows of ``table`` as ``grow`` and ``held_out_scores`` read them, for several calls."""
    return _packed(table.rows, sorted(folds))


def _packed(rows: DataFrame, folds: Sequence[int]) -> DataFrame:
    """The binned table with some ``BLOCK`` rows in one, every column as bytes: a level reads it once more.
    The blocks are dealt evenly, whatever partitions the rows come in."""
    names = ["h", "y", "fold", *[f"x{f}" for f in folds]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            plain = [batch[c].to_numpy(zero_copy_only=False).tobytes() for c in names[:3]]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*plain, *[b"".join(batch[c].to_pylist()) for c in names[3:]])], names=names)

    blocks = rows.select(*names).mapInArrow(run, ", ".join(f"{c} binary" for c in names))
    return cut_lineage(blocks.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def _histograms(ensembles, layouts, trees, grown):
    """One row per (tree, node): the node's histogram as float64 (cells x 3)."""
    if all(_is_forest(ensembles[k]) for k, *_ in trees):
        return _forest_histograms(ensembles, layouts, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, before = [_TreeSums(ensembles[k], layouts[k], t, nodes, looks[0]) for k, _, t, nodes, looks in trees], _with_paths(grown)
        for batch in batches:
            for block in batch.to_pylist():
                b = _Block(block, ensembles, before)
                for s, (k, number, *_) in zip(sums, trees):
                    s.add(b, k, number)
        for i, s in enumerate(sums):
            cells = s.cells()
            used = np.flatnonzero(cells[:, :, 2].any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)),
                                              pa.array([cells[j].tobytes() for j in used], pa.binary())], names=["tree", "node", "cells"])
    return run


def best_split(cells: np.ndarray, first: np.ndarray, looks: np.ndarray, e: Ensemble) -> tuple:
    """``feature, cut, gain, left sums, all sums`` of the best split of a node's histogram; feature -1
    if there is none.  Ties go to the first feature and the lowest cut."""
    width = np.diff(first)
    of = np.repeat(np.arange(len(width)), width)
    upto = np.cumsum(cells, 0)
    base = np.vstack((np.zeros((1, 3)), upto))[first[:-1]]
    left = upto - base[of]
    total = cells[first[looks[0]]:first[looks[0] + 1]].sum(0)
    right = total - left
    may = np.zeros(len(width), bool)
    may[looks] = True
    ok = may[of]
    ok[first[1:] - 1] = False                                   # nothing stays on the right
    ok &= (left[:, 2] >= max(1, e.min_leaf)) & (right[:, 2] >= max(1, e.min_leaf))
    with np.errstate(divide="ignore", invalid="ignore"):
        if e.kind == "gini":
            impurity = lambda s: np.where(s[..., 0] + s[..., 1] > 0, 2 * s[..., 0] * s[..., 1] / (s[..., 0] + s[..., 1]), 0.0)
            gain = impurity(total) - impurity(left) - impurity(right)
            least = scale = FLAT * (total[0] + total[1])
        else:
            ok &= (left[:, 1] >= e.min_hessian) & (right[:, 1] >= e.min_hessian)
            worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + e.l2)
            gain = 0.5 * (worth(left) + worth(right) - worth(total))
            least, scale = 1e-9, FLAT * abs(float(worth(total)))
    gain = np.where(ok, gain, -1.0)
    # sums in another order differ in the last bits: gains this close are ties
    top = float(gain.max())
    k = int(np.flatnonzero(gain >= top - 10 * (scale + FLAT * abs(top)))[0])
    if gain[k] <= least:
        return -1, 0, 0.0, total, total
    return int(of[k]), int(k - first[of[k]]), float(gain[k]), left[k], total


_SPLIT = "tree int, node int, feature int, cut int, gain double, la double, lb double, ln double, a double, b double, n double"


def _choose(ensembles, layouts, trees):
    narrow = all(_is_forest(ensembles[k]) for k, *_ in trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, total = None, None

        def close() -> None:
            i, j = key
            k, _, _, _, looks = trees[i]
            own = looks[j if len(looks) > 1 else 0]
            if narrow:          # the cells are those of the node's columns
                first = np.concatenate(([0], np.cumsum(np.diff(layouts[k])[own])))
                f, cut, gain, left, every = best_split(total, first, np.arange(len(own)), ensembles[k])
                f = int(own[f]) if f >= 0 else f
            else:
                f, cut, gain, left, every = best_split(total, layouts[k], own, ensembles[k])
            out.append((i, j, f, cut, gain, *left.tolist(), *every.tolist()))

        for batch in batches:
            for i, j, raw in zip(batch["tree"].to_pylist(), batch["node"].to_pylist(), batch["cells"].to_pylist()):
                cells = np.frombuffer(raw, float).reshape(-1, 3)
                if key == (i, j):
                    total = total + cells
                    continue
                if key is not None:
                    close()
                key, total = (i, j), cells
        if key is not None:
            close()
        names = [x.split()[0] for x in _SPLIT.split(", ")]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({c: "int32" for c in ("tree", "node", "feature", "cut")}), preserve_index=False)
    return run


def _cells(e: Ensemble, layout: np.ndarray) -> int:
    """Histogram cells of a node: of all columns, or, in a forest, of as many average ones as it looks at."""
    d, cells = len(layout) - 1, int(layout[-1])
    return -(-cells * min(d, max(1, int(e.columns))) // max(1, d)) if _is_forest(e) else cells


def _level(table: Binned, packed: DataFrame, ensembles: list[Ensemble], trees: list[Tree], grown: list[list[dict]]) -> None:
    """Splits the open nodes of ``trees`` (one job per ``CELLS`` histogram cells)."""
    layouts = {k: table.layout(ensembles[k].fold) for k in {t.of for t in trees}}
    a_node = {k: _cells(ensembles[k], v) for k, v in layouts.items()}
    todo = sorted((t for t in trees if t.open), key=lambda t: not _is_forest(ensembles[t.of]))
    while todo:
        chunk: list[Tree] = []
        cells = 0
        while todo and (not chunk or (cells + len(todo[0].open) * a_node[todo[0].of] <= CELLS
                                      and _is_forest(ensembles[todo[0].of]) == _is_forest(ensembles[chunk[0].of]))):
            cells += len(todo[0].open) * a_node[todo[0].of]
            chunk.append(todo.pop(0))
        sent = []
        for t in chunk:
            e, d = ensembles[t.of], len(layouts[t.of]) - 1
            looks = _columns_of_nodes(e, t.number, [t.place[j] for j in t.open], d) if _is_forest(e) else [_columns_of(e, t.number, t.place[t.open[0]], d)]
            sent.append((t.of, t.number, t.arrays(e), np.array(t.open), looks))
        of_chunk = {t.of for t in chunk}
        context = packed.sparkSession.sparkContext
        shared = context.broadcast((ensembles, layouts, sent, [g if k in of_chunk else [] for k, g in enumerate(grown)]))

        def histograms(batches):
            return _histograms(*shared.value)(batches)

        def choose(batches):
            return _choose(*shared.value[:3])(batches)

        parts = min(len(chunk) * 4, context.defaultParallelism)
        names = [c for c in packed.columns if c in ("h", "y", "fold", "margin") or c in {f"x{ensembles[k].fold}" for k in of_chunk}]
        read = packed.select(*names).coalesce(context.defaultParallelism)     # every task hands over its sums: not more tasks than cores
        got = (read.mapInArrow(histograms, "tree int, node int, cells binary")
               .repartition(parts, "tree", "node").sortWithinPartitions("tree", "node").mapInArrow(choose, _SPLIT).collect())
        shared.destroy()
        for r in sorted(got, key=lambda r: (r["tree"], r["node"])):
            _apply(chunk[r["tree"]], ensembles[chunk[r["tree"]].of], sent[r["tree"]][3][r["node"]], r)
        for t, (_, _, _, nodes, _) in zip(chunk, sent):
            done = set(nodes.tolist())
            t.open = [j for j in t.open if j not in done]


def _apply(t: Tree, e: Ensemble, node: int, r) -> None:
    node = int(node)
    every, left = (r["a"], r["b"], int(r["n"])), (r["la"], r["lb"], int(r["ln"]))
    t.stats[node] = every
    if r["feature"] < 0 or every[2] < e.min_split or t.depth[node] >= e.depth:
        return
    t.feature[node], t.cut[node], t.left[node], t.gain[node] = r["feature"], r["cut"], len(t.feature), r["gain"]
    for side, s in enumerate((left, tuple(x - y for x, y in zip(every, left)))):
        t.feature.append(-1)
        t.cut.append(0)
        t.left.append(0)
        t.depth.append(t.depth[node] + 1)
        t.place.append((2 * t.place[node] + side) & ((1 << 63) - 1))
        t.stats.append(s)
        t.gain.append(0.0)
        pure = e.kind == "gini" and (s[0] <= FLAT or s[1] <= FLAT)
        if t.depth[-1] < e.depth and s[2] >= max(e.min_split, 2 * e.min_leaf) and not pure:
            t.open.append(len(t.feature) - 1)


# ---------------------------------------------------------------- small nodes

_MEMBER = "tree int, node int, y binary, times binary, x binary"
_KINDS = {"feature": np.int32, "cut": np.int32, "left": np.int32, "depth": np.int32, "place": np.int64, "gain": np.float64,
          "a": np.float64, "b": np.float64, "n": np.int64}
_SUBTREE = "tree int, node int, " + ", ".join(f"{c} binary" for c in _KINDS)
_SCORE = "model string, fold int, y int, p double"


def _members(ensembles, trees, held):
    """The rows of every waiting node, those of a block together; ``held``: also the rows that were held out, counting 0 times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [_Paths(t) for _, _, t, _, _ in trees]
        for batch in batches:
            for block in batch.to_pylist():
                b = _Block(block, ensembles, [[] for _ in ensembles])
                y = b.y.astype(np.uint8)
                for i, (k, number, t, nodes, _) in enumerate(trees):
                    e = ensembles[k]
                    times, xf = b.times(k, number), b.x(e.fold)
                    waits = np.zeros(len(t["feature"]), bool)
                    waits[nodes] = True
                    at = paths[i].ends(*xf)
                    use = np.flatnonzero(waits[at] & ((times > 0) | ((b.fold == e.fold) & held)))
                    if not len(use):
                        continue
                    use = use[np.argsort(at[use], kind="stable")]
                    cuts = np.flatnonzero(np.diff(at[use], prepend=-1))
                    ends = [*cuts[1:].tolist(), len(use)]
                    x = xf[0].reshape(len(y), -1)
                    columns = ([v[use[p:q]].tobytes() for p, q in zip(cuts.tolist(), ends)] for v in (y, times, x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), i, np.int32)), pa.array(at[use[cuts]].astype(np.int32)),
                                                      *[pa.array(v, pa.binary()) for v in columns]], names=["tree", "node", "y", "times", "x"])
    return run


def _best_gini(e: Ensemble, first: np.ndarray, rows: np.ndarray, weighed: np.ndarray, may: np.ndarray | None) -> tuple:
    """``best_split`` of many nodes at once.  ``rows``, ``weighed``: node x class x cell; ``may``: node x cell."""
    width = np.diff(first)

    def sums(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = cells.cumsum(2)
        before = np.concatenate((np.zeros_like(upto[:, :, :1]), upto[:, :, first[1:-1] - 1]), 2)
        return upto - np.repeat(before, width, 2), cells[:, :, :first[1]].sum(2)

    left, every = sums(rows)
    n_left, n = left.sum(1), every.sum(1)
    if weighed is not rows:
        left, every = sums(weighed)
    a, b = e.weights[0] * left[:, 0], e.weights[1] * left[:, 1]
    all_a, all_b = e.weights[0] * every[:, 0], e.weights[1] * every[:, 1]

    def impurity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = a + b
        return np.where(s > 0, 2 * a * b / s, 0.0)

    least = max(1, e.min_leaf)
    ok = (n_left >= least) & (n[:, None] - n_left >= least)
    ok[:, first[1:] - 1] = False                                # nothing stays on the right
    if may is not None:
        ok &= may
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity(all_a, all_b)[:, None] - impurity(a, b) - impurity(all_a[:, None] - a, all_b[:, None] - b)
    gain = np.where(ok, gain, -1.0)
    top, scale = gain.max(1), FLAT * (all_a + all_b)
    k = (gain >= (top - 10 * (scale + FLAT * np.abs(top)))[:, None]).argmax(1)      # gains this close are ties
    each = np.arange(len(k))
    of = np.searchsorted(first, k, side="right") - 1
    gain = gain[each, k]
    return np.where(gain > scale, of, -1), k - first[of], gain, (a[each, k], b[each, k], n_left[each, k]), (all_a, all_b, n)


def _subtree(e: Ensemble, first: np.ndarray, number: int, depth: int, place: int, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
    """The tree below a node, from the node's rows, level by level: a level's nodes are split together."""
    cells, d, room = int(first[-1]), len(first) - 1, max(1, PART // int(first[-1]))
    once = bool((times == 1).all())
    at = first[:-1] + x.astype(np.intp)                         # a row's cells
    rows, slot = np.arange(len(x)), np.zeros(len(x), np.intp)   # rows in open nodes, ordered by node
    level = {"depth": depth, "place": np.array([place], np.uint64), "open": np.zeros(1, np.intp), "n": None}
    out: dict[str, list[np.ndarray]] = {c: [] for c in _KINDS}
    done = 0
    while True:
        m, nodes = len(level["open"]), len(level["place"])
        found = []
        for p in range(0, m, room):
            q = min(m, p + room)
            r = slice(*np.searchsorted(slot, (p, q)))
            key = (2 * (slot[r] - p) + y[rows[r]]) * cells
            i = (key[:, None] + at[rows[r]]).ravel()
            size = 2 * (q - p) * cells
            hist = np.bincount(i, minlength=size).reshape(q - p, 2, cells)
            weighed = hist if once else np.bincount(i, np.repeat(times[rows[r]], d), size).reshape(q - p, 2, cells)
            may = None
            if e.columns is not None:
                may = np.zeros((q - p, d), bool)
                for own, looks in zip(may, _columns_of_nodes(e, number, level["place"][level["open"][p:q]], d)):
                    own[looks] = True
                may = np.repeat(may, np.diff(first), 1)
            found.append(_best_gini(e, first, hist, weighed, may))
        feature, cut, gain = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
        left, every = (tuple(np.concatenate([f[c][s] for f in found]) if found else np.zeros(0) for s in range(3)) for c in (3, 4))
        if level["n"] is None:
            level |= {"a": every[0], "b": every[1], "n": every[2]}
        split = np.flatnonzero((feature >= 0) & (every[2] >= e.min_split) & (level["depth"] < e.depth))
        wide = {c: np.full(nodes, fill, _KINDS[c]) for c, fill in (("feature", -1), ("cut", 0), ("left", 0), ("gain", 0))}
        where = level["open"][split]
        for c, v in (("feature", feature[split]), ("cut", cut[split]), ("gain", gain[split]), ("left", done + nodes + 2 * np.arange(len(split)))):
            wide[c][where] = v
        for c in _KINDS:
            out[c].append((wide[c] if c in wide else np.full(nodes, level["depth"]) if c == "depth" else level[c]).astype(_KINDS[c]))
        if not len(split):
            break
        done += nodes
        both = lambda one, other: np.stack((one, other), 1).ravel()
        a, b, n = (both(one[split], other[split] - one[split]) for one, other in zip(left, every))
        parent = np.repeat(level["place"][where], 2)
        side = np.tile(np.array([0, 1], np.uint64), len(split))
        child_place = (np.uint64(2) * parent + side) & np.uint64((1 << 63) - 1)
        deeper = level["depth"] + 1
        opened = np.flatnonzero((n >= max(e.min_split, 2 * e.min_leaf)) & (a > FLAT) & (b > FLAT)) if deeper < e.depth else np.zeros(0, np.intp)
        rank, child = np.full(m, -1), np.full(2 * len(split), -1)
        rank[split], child[opened] = np.arange(len(split)), np.arange(len(opened))
        keep = np.flatnonzero(rank[slot] >= 0)
        rows, slot = rows[keep], slot[keep]
        slot = child[2 * rank[slot] + (x[rows, feature[slot].astype(np.intp)] > cut[slot])]
        keep = np.flatnonzero(slot >= 0)
        keep = keep[np.argsort(slot[keep].astype(np.uint16 if len(opened) < 1 << 16 else np.int64), kind="stable")]
        rows, slot = rows[keep], slot[keep]
        level = {"depth": deeper, "place": child_place, "open": opened, "a": a, "b": b, "n": n}
    return {c: np.concatenate(v) for c, v in out.items()}


def _finish(ensembles, layouts, trees, cuts=None):
    """From the rows of each waiting node, which come together: the tree below it, or, for ``cuts``, what it
    scores the held-out rows with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        where = [{int(j): p for j, p in zip(nodes, starts)} for _, _, _, nodes, starts in trees]
        scores: list[tuple[str, int, np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            i, node = key
            k, number, _, _, _ = trees[i]
            e = ensembles[k]
            y, times, x = (np.frombuffer(b"".join(v), np.uint8) for v in zip(*held))
            x = x.reshape(len(y), -1)
            depth, place = where[i][node]
            use = np.flatnonzero(times)
            t = _subtree(e, layouts[k], number, depth, place, x[use], y[use].astype(np.intp), times[use])
            if cuts is None:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([node], pa.int32()), *[pa.array([t[c].tobytes()], pa.binary()) for c in _KINDS]],
                                                 names=["tree", "node", *_KINDS])
                return
            out = np.flatnonzero(times == 0)
            # the others end above this node
            mine = [c for c in cuts if c.of == k and (c.depth is None or depth < c.depth) and t["n"][0] >= c.min_split]
            value = np.divide(t["b"], t["a"] + t["b"], out=np.zeros(len(t["a"])), where=t["a"] + t["b"] > 0)
            ends = _walk(t, x[out])
            for c, last in zip(mine, _last_nodes(t, [(c.depth, c.min_split) for c in mine])):
                scores.append((c.name, e.fold, y[out], value[last[ends]]))
            if sum(len(v[2]) for v in scores) >= 1 << 17:
                yield flushed()

        def flushed() -> pa.RecordBatch:
            got = _score_batch(scores)
            scores.clear()
            return got

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["tree"], row["node"]):
                    if key is not None:
                        yield from close()
                    key, held = (row["tree"], row["node"]), []
                held.append((row["y"], row["times"], row["x"]))
        if key is not None:
            yield from close()
        if scores:
            yield flushed()
    return run


def _score_batch(scores: Sequence[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(model, fold, y, p) of some rows each as one batch."""
    sizes = [len(p) for _, _, _, p in scores]
    named = pa.array(np.repeat(np.arange(len(scores)), sizes))
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, *_ in scores], pa.string()).take(named), pa.array(np.repeat(np.array([f for _, f, *_ in scores], np.int32), sizes)),
         pa.array(np.concatenate([y for _, _, y, _ in scores]).astype(np.int32)), pa.array(np.concatenate([p for *_, p in scores]).astype(float))],
        names=["model", "fold", "y", "p"])


def _last_nodes(t: dict[str, np.ndarray], limits: Sequence[tuple[int | None, int]]) -> list[np.ndarray]:
    """For each (depth, minimum split): the node above which, or at which, a row stops that ends in a node of
    the whole tree.  Children come after their parent."""
    inner = np.flatnonzero(t["feature"] >= 0)
    parent = np.zeros(len(t["feature"]), np.intp)
    parent[t["left"][inner]], parent[t["left"][inner] + 1] = inner, inner
    goes = np.stack([(t["feature"] >= 0) & (t["n"] >= least) & (t["depth"] < (1 << 30 if depth is None else depth)) for depth, least in limits], 1) if limits else None
    last = np.zeros((len(parent), len(limits)), np.intp)
    for at in range(int(t["depth"][0]) + 1, int(t["depth"].max()) + 1):
        nodes = np.flatnonzero(t["depth"] == at)
        above = parent[nodes]
        last[nodes] = np.where(goes[above] & (last[above] == above[:, None]), nodes[:, None], last[above]) if limits else 0
    return list(last.T)


def _finishing(table: Binned, packed: DataFrame, ensembles: list[Ensemble], trees: list[Tree], waiting: dict[int, list[int]],
               schema: str, cuts: Sequence[Cut] | None = None) -> DataFrame:
    """The rows of the waiting nodes (by place in ``trees``) brought together and grown to the end."""
    of = {trees[i].of for i in waiting}
    layouts = {k: table.layout(ensembles[k].fold) for k in of}
    sent = [(trees[i].of, trees[i].number, trees[i].arrays(ensembles[trees[i].of]), np.array(nodes),
             [(trees[i].depth[j], trees[i].place[j]) for j in nodes]) for i, nodes in waiting.items()]
    context = packed.sparkSession.sparkContext
    shared = context.broadcast((ensembles, layouts, sent, cuts))

    def members(batches):
        es, _, ts, wanted = shared.value
        return _members(es, ts, wanted is not None)(batches)

    def finish(batches):
        return _finish(*shared.value)(batches)

    names = ["h", "y", "fold", *sorted({f"x{ensembles[k].fold}" for k in of})]
    return (packed.select(*names).mapInArrow(members, _MEMBER).repartition(4 * context.defaultParallelism, "tree", "node")
            .sortWithinPartitions("tree", "node").mapInArrow(finish, schema))


def _finish_small(table: Binned, packed: DataFrame, ensembles: list[Ensemble], trees: list[Tree], waiting: dict[int, list[int]]) -> None:
    """Grows the waiting nodes (by place in ``trees``) to the end and hangs what grew below them."""
    own = list(waiting)
    for r in _finishing(table, packed, ensembles, trees, waiting, _SUBTREE).collect():
        t, node = trees[own[r["tree"]]], r["node"]
        new = {c: np.frombuffer(r[c], kind) for c, kind in _KINDS.items()}
        base = len(t.feature) - 1                 # the subtree's root is the node itself
        left = np.where(new["feature"] >= 0, base + new["left"], 0)
        stats = list(zip(*(new[c].tolist() for c in ("a", "b", "n"))))
        for kept, more in ((t.feature, new["feature"].tolist()), (t.cut, new["cut"].tolist()), (t.left, left.tolist()), (t.gain, new["gain"].tolist()), (t.stats, stats)):
            kept[node] = more[0]
            kept += more[1:]
        t.depth += new["depth"][1:].tolist()
        t.place += new["place"][1:].tolist()


# ---------------------------------------------------------------- ensembles

def _with_margins(packed: DataFrame, ensembles: list[Ensemble], grown: list[list[dict]]) -> DataFrame:
    """The packed table with each row's margin under every boosted ensemble, written."""
    shared = packed.sparkSession.sparkContext.broadcast((ensembles, grown))
    names = [c for c in packed.columns if c != "margin"]
    schema = ", ".join(f"{c} binary" for c in (*names, "margin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        es, before = shared.value[0], _with_paths(shared.value[1])
        for batch in batches:
            for block in batch.to_pylist():
                b = _Block(block, es, before)
                m = np.concatenate([b.margin(k) for k in range(len(es))])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*[block[c] for c in names], m.tobytes())], names=[*names, "margin"])

    out = cut_lineage(packed.mapInArrow(run, schema))
    shared.destroy()
    return out


def grow(table: Binned, ensembles: list[Ensemble], later: dict[int, list[int]] | None = None, packed: DataFrame | None = None) -> list[list[Tree]]:
    """The trees of every ensemble.  Independent trees grow side by side; boosted ensembles go round by
    round, all of them in the same jobs.  With ``later`` the waiting nodes of single trees are left ungrown and
    go there, by ensemble."""
    out: list[list[Tree]] = [[] for _ in ensembles]
    nothing: list[list[dict]] = [[] for _ in ensembles]
    free = [Tree(k, i) for k, e in enumerate(ensembles) if e.kind == "gini" for i in range(e.trees)]
    cells = {k: _cells(e, table.layout(e.fold)) for k, e in enumerate(ensembles) if e.kind == "gini"}
    waiting: dict[int, list[int]] = {}
    packed = _packed(table.rows, sorted({e.fold for e in ensembles})) if packed is None else packed
    while any(t.open for t in free):
        crowded = sum(len(t.open) * cells[t.of] for t in free) > CELLS
        for i, t in enumerate(free):
            most = SINGLE if ensembles[t.of].trees == 1 else SMALL if crowded else 0
            if most:
                # two levels above the limit another pass costs less than sending the rows
                small = [j for j in t.open if j and t.stats[j][2] <= most and t.depth[j] + 2 < ensembles[t.of].depth]
                if small:
                    waiting.setdefault(i, []).extend(small)
                    kept = set(small)
                    t.open = [j for j in t.open if j not in kept]
        _level(table, packed, ensembles, free, nothing)
    if later is not None:
        single = [i for i in waiting if ensembles[free[i].of].trees == 1]
        later |= {free[i].of: waiting.pop(i) for i in single}
    if waiting:
        _finish_small(table, packed, ensembles, free, waiting)
    for i, t in enumerate(free):
        out[t.of].append(trimmed(t, None, 0) if i in waiting else t)   # nodes in order of their level
    boosted = [k for k, e in enumerate(ensembles) if e.kind == "logistic"]
    grown, rows = [list(x) for x in nothing], packed
    for i in range(max((ensembles[k].trees for k in boosted), default=0)):
        if i and i % MARGIN_ROUNDS == 0:
            rows = _with_margins(rows, ensembles, grown)
            grown = [list(x) for x in nothing]
        trees = [Tree(k, i) for k in boosted if i < ensembles[k].trees]
        while any(t.open for t in trees):
            _level(table, rows, ensembles, trees, grown)
        for t in trees:
            out[t.of].append(t)
            grown[t.of].append(t.arrays(ensembles[t.of]))
    return out


@dataclass(frozen=True)
class Cut:
    """A candidate inside a grown ensemble: its first ``trees`` trees, down to ``depth``, with nodes of
    fewer than ``min_split`` rows as leaves (the last two for independent trees)."""
    name: str
    of: int
    trees: int
    depth: int | None = None
    min_split: int = 0


def _cut_scores(cuts: Sequence[Cut], ensemble: Ensemble, trees: list[tuple[dict, _Paths, list[np.ndarray]]], limits: list[tuple], xf: np.ndarray,
                off: np.ndarray) -> Iterator[tuple[Cut, np.ndarray, np.ndarray | None]]:
    """Probability of every cut of one ensemble, adding up trees once per (depth, minimum split), and the rows that
    have one (None: all); a row that a cut leads into a waiting node has none."""
    total = np.zeros((len(limits), len(off)))
    for i, (t, paths, last) in enumerate(trees, 1):
        ends = paths.ends(xf, off)
        for j, limit in enumerate(limits):
            at = last[j][ends]
            total[j] += t["value"].take(at)
            for c in cuts:
                if c.trees == i and (c.depth, c.min_split) == limit:
                    here = None
                    if "waits" in t:
                        here = np.flatnonzero(~(t["waits"][at] & (t["n"][at] >= c.min_split) & (t["depth"][at] < (1 << 30 if c.depth is None else c.depth))))
                    yield c, total[j] / i if ensemble.kind == "gini" else 1.0 / (1.0 + np.exp(-total[j])), here


def held_out_scores(table: Binned, ensembles: list[Ensemble], grown: list[list[Tree]], cuts: Sequence[Cut],
                    later: dict[int, list[int]] | None = None, packed: DataFrame | None = None) -> DataFrame:
    """``model`` (the cut's name), ``fold, y, p``: every row scored by all cuts of the ensembles that held
    it out, in one pass.  The nodes in ``later`` are grown on the way."""
    packed = _packed(table.rows, sorted({e.fold for e in ensembles})) if packed is None else packed
    sent = [[t.arrays(e) for t in ts] for e, ts in zip(ensembles, grown)]
    for k, nodes in (later or {}).items():
        waits = np.zeros(len(sent[k][0]["feature"]), bool)
        waits[nodes] = True
        sent[k][0]["waits"] = waits
    shared = packed.sparkSession.sparkContext.broadcast((ensembles, sent, list(cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        es, trees, wanted = shared.value
        of = [[c for c in wanted if c.of == k] for k in range(len(es))]
        limits = [sorted({(c.depth, c.min_split) for c in cs}, key=str) for cs in of]
        ready = [[(t, _Paths(t), _last_nodes(t, limit)) for t in ts] for ts, limit in zip(trees, limits)]
        for batch in batches:
            for block in batch.to_pylist():
                b = _Block(block, es, [])
                for k, e in enumerate(es):
                    use = np.flatnonzero(b.fold == e.fold)
                    if not len(use) or not of[k]:
                        continue
                    xf, off = b.x(e.fold)
                    y, scores = b.y[use], []
                    for c, p, here in _cut_scores(of[k], e, ready[k], limits[k], xf, off[use]):
                        scores.append((c.name, e.fold, y if here is None else y[here], p if here is None else p[here]))
                    yield _score_batch(scores)

    scores = packed.mapInArrow(run, _SCORE)
    if not later:
        return scores
    trees = [ts[0] for ts in (grown[k] for k in later)]
    return scores.unionByName(_finishing(table, packed, ensembles, trees, dict(enumerate(later.values())), _SCORE, list(cuts)))


def trimmed(t: Tree, depth: int | None, min_split: int) -> Tree:
    """The tree with everything below a cut taken out."""
    out = Tree(t.of, t.number, [], [], [], [], [], [], [], [])
    order = [0]
    for j in order:                       # breadth first, children side by side
        inner = t.feature[j] >= 0 and (depth is None or t.depth[j] < depth) and t.stats[j][2] >= min_split
        out.feature.append(t.feature[j] if inner else -1)
        out.cut.append(t.cut[j] if inner else 0)
        out.left.append(len(order) if inner else 0)
        out.gain.append(t.gain[j] if inner else 0.0)
        out.depth.append(t.depth[j])
        out.place.append(t.place[j])
        out.stats.append(t.stats[j])
        if inner:
            order += [t.left[j], t.left[j] + 1]
    return out


class TreeModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A grown ensemble as a pipeline stage: ``features`` (vector) to ``probability`` (vector of two)
    and ``prediction``.  Saved and loaded with its ``PipelineModel``."""

    nodes = Param(Params._dummy(), "nodes", "the trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, nodes: str = "{}") -> None:
        super().__init__()
        self._set(nodes=nodes)

    @staticmethod
    def of(ensemble: Ensemble, trees: Sequence[Tree], edges: list[list[float]]) -> "TreeModel":
        kept = []
        for t in trees:
            a = t.arrays(ensemble)
            cut = [edges[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
            kept.append({"feature": t.feature, "cut": cut, "left": t.left, "value": a["value"].tolist(), "gain": t.gain, "n": [s[2] for s in t.stats]})
        return TreeModel(nodes=json.dumps({"kind": ensemble.kind, "size": len(edges), "trees": kept}))

    def _model(self) -> dict:
        return json.loads(self.getOrDefault(self.nodes))

    @property
    def featureImportances(self) -> DenseVector:
        """Gain per feature, adding up to one."""
        model = self._model()
        total = np.zeros(model["size"])
        for t in model["trees"]:
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    total[f] += g
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self._model()
        trees = [(np.array(t["value"]), {c: np.array(t[c]) for c in ("feature", "cut", "left", "n")}) for t in model["trees"]]
        shared = dataset.sparkSession.sparkContext.broadcast((model["kind"], model["size"], trees))

        @F.pandas_udf("array<double>")
        def probability(features: pd.Series) -> pd.Series:
            kind, size, trees = shared.value
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, size))
            total = np.zeros(len(x))
            for value, t in trees:
                total += value[_walk(t, x)]
            p = total / max(1, len(trees)) if kind == "gini" else 1.0 / (1.0 + np.exp(-total))
            return pd.Series(list(np.stack((1 - p, p), 1)))

        return (dataset.withColumn("probability", array_to_vector(probability(vector_to_array("features"))))
                .withColumn("prediction", (vector_to_array("probability")[1] > 0.5).cast("double")))


def mean_importance(trees: Sequence[Tree], size: int) -> list[float]:
    """Gain per feature, as shares of each tree's gain, averaged over the trees that split.  As in Spark ML's
    trees a split does not count if all that hangs below it predicts the same class."""
    total = np.zeros(size)
    for t in trees:
        leaf, likely = [f < 0 for f in t.feature], [s[1] > s[0] for s in t.stats]
        own = np.zeros(size)
        for j in range(len(t.feature) - 1, -1, -1):       # children come after their parent
            if t.feature[j] < 0:
                continue
            a, b = t.left[j], t.left[j] + 1
            if leaf[a] and leaf[b] and likely[a] == likely[b]:
                leaf[j], likely[j] = True, likely[a]
            else:
                own[t.feature[j]] += t.gain[j]
        total += own / own.sum() if own.sum() else own
    return (total / total.sum() if total.sum() else total).tolist()


def refit(ensemble: Ensemble, **changes) -> Ensemble:
    return replace(ensemble, **changes)
