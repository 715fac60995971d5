"""Operator 4: best-fit packing of tokenised documents with swap-based local search.

Every document's ids end with one end id; only documents longer than a sequence are cut.  Pieces
are dealt into groups of bounded size by a hash of their row number.  A group is packed by best fit
in decreasing order; then a local search empties its least filled bins by moves, one-for-one and
two-for-one exchanges with fuller, underfull bins.  Every accepted exchange shifts tokens from the
emptier to the fuller bin, which raises the sum of squared fills, so the search ends.  The loosest
bins of all groups are then dealt into fewer groups and packed again, until one group remains.

Defined cases: a null or empty text is one piece with the end id only; repeated rows and ids are
pieces of their own; ties are broken by row number; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import staged
from hrlens.llm.textkit import gives_back, slices
from hrlens.llm.tokens import CACHE, tokenizer

SIZE = 4096
GROUP = 4096     # pieces that one task packs together
LOOSE = 16       # one bin in so many goes on to the next round
END_ID = 1
SLICE_BYTES = 500_000   # bytes of whole texts that are tokenised together
DONORS = 16      # emptiest bins that the local search lets give
REACH = 512      # emptiest of the fuller bins that they exchange with (moves see all of them)


def _pieces(size: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for s in slices(batch["text"], SLICE_BYTES):
                ids, n = coder.ids_of(s)
                total = n + 1
                ends = np.cumsum(total)
                flow = np.full(int(ends[-1]), END_ID, np.uint32)
                flow[np.arange(len(ids)) + np.repeat(np.arange(s.n), n)] = ids
                rows: dict[str, list] = {"uid": [], "doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                kept = []
                for i in range(s.n):
                    a, b = int(ends[i] - total[i]), int(ends[i])
                    for p, at in enumerate(range(a, b, size)):
                        part = flow[at:min(at + size, b)]
                        rows["uid"].append(uid)
                        rows["doc_id"].append(doc_ids[s.first + i])
                        rows["piece"].append(p)
                        rows["start"].append(at - a)
                        rows["length"].append(len(part))
                        rows["ids_crc32"].append(zlib.crc32(part.astype("<u4").tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                        uid += 1
                cols = [pa.array(rows[c], pa.int32() if c == "piece" else pa.int64()) for c in rows]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*rows, "ids"][:len(cols)])
    return run


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit decreasing: each piece goes to the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        j = bisect.bisect_left(room, (need, -1))
        if j < len(room):
            free, b = room.pop(j)
            bins[b].append(i)
            free -= need
        else:
            b, free = len(bins), size - need
            bins.append([i])
        if free:
            bisect.insort(room, (free, b))
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Local search: exchanges shift tokens from an emptier to a fuller bin, the emptiest bins
    giving first, until a bin is empty and goes; ends at the lower bound or when none of the
    ``DONORS`` emptiest bins has an exchange left that raises the sum of squared fills."""
    state = _Search(lengths, bins, size)
    least = -(-int(lengths.sum()) // size)
    while len(state.bins) > least and any(state.exchange(d) for d in np.argsort(-state.free, kind="stable")[:DONORS].tolist()):
        pass
    return state.bins


class _Search:
    """Bins with, for each, its pieces and pairs of pieces as arrays."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], size: int) -> None:
        self.lengths, self.bins = lengths, [list(b) for b in bins]
        self.free = size - np.array([lengths[b].sum() for b in bins])
        self.single: list[np.ndarray] = []
        self.double: list[tuple[np.ndarray, np.ndarray]] = []
        for b in self.bins:
            self.single.append(np.array(b))
            self.double.append(self._pairs(b))

    def _pairs(self, held: list[int]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.triu_indices(len(held), 1)
        own = np.array(held, np.int64)
        return own[x], own[y]

    def _set(self, b: int, held: list[int], free: int) -> None:
        self.bins[b], self.free[b] = held, free
        self.single[b], self.double[b] = np.array(held, np.int64), self._pairs(held)

    def exchange(self, d: int) -> bool:
        """The move, or else the exchange, that takes the most tokens out of bin ``d``."""
        lengths, free = self.lengths, self.free
        others = np.flatnonzero((free > 0) & (free <= free[d]))
        others = others[others != d]
        if not len(others):
            return False
        mine = sorted(self.bins[d], key=lambda i: (-lengths[i], i))
        room = free[others]
        for i in mine:  # move: into the tightest bin that has room
            fit = np.flatnonzero(room >= lengths[i])
            if len(fit):
                return self._swap(d, int(others[fit[room[fit].argmin()]]), [i], [])
        if len(others) > REACH:
            others = others[np.argsort(-room, kind="stable")[:REACH]]
        theirs = np.concatenate([self.single[b] for b in others])
        home = np.repeat(others, [len(self.single[b]) for b in others])
        one = np.concatenate([self.double[b][0] for b in others])
        two = np.concatenate([self.double[b][1] for b in others])
        pair_home = np.repeat(others, [len(self.double[b][0]) for b in others])
        best: tuple[int, int, list[int], list[int]] = (0, -1, [], [])

        def offer(give: list[int], taken: np.ndarray, where: np.ndarray, take) -> None:
            nonlocal best
            gain = lengths[give].sum() - taken
            gain = np.where(gain <= free[where], gain, 0)
            if len(gain):
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), int(where[k]), give, take(k))

        single, pair = lengths[theirs], lengths[one] + lengths[two]
        for x, i in enumerate(mine):
            offer([i], single, home, lambda k: [int(theirs[k])])                    # one for one
            offer([i], pair, pair_home, lambda k: [int(one[k]), int(two[k])])       # one for two of theirs
            for j in mine[x + 1:]:
                offer([i, j], single, home, lambda k: [int(theirs[k])])             # two for one
        return best[0] > 0 and self._swap(d, best[1], best[2], best[3])

    def _swap(self, d: int, b: int, give: list[int], take: list[int]) -> bool:
        gain = int(self.lengths[give].sum() - self.lengths[take].sum())
        self._set(b, [j for j in self.bins[b] if j not in take] + give, int(self.free[b]) - gain)
        self._set(d, [i for i in self.bins[d] if i not in give] + take, int(self.free[d]) + gain)
        if not self.bins[d]:
            for part in (self.bins, self.single, self.double):
                part.pop(d)
            self.free = np.delete(self.free, d)
        return True


def _pack(size: int, turn: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = improve(lengths, best_fit(lengths, size), size)
        fill = np.array([lengths[b].sum() for b in bins])
        order = np.argsort(fill, kind="stable")
        loose = set() if last else set(order[:-(-len(bins) // LOOSE)][fill[order[:-(-len(bins) // LOOSE)]] < size].tolist())
        seq = np.empty(len(rows), np.int64)
        offset = np.empty(len(rows), np.int64)
        done = np.ones(len(rows), bool)
        for k, b in enumerate(bins):
            at = np.array(sorted(b))
            seq[at] = (turn << 56) | (int(key[0]) << 16) | k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
            done[at] = k not in loose
        return rows.assign(sequence_id=seq, offset=offset, done=done)[["uid", "length", "sequence_id", "offset", "done"]]
    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids`` on request).  ``vocabulary`` is the tokenizer file, the packaged public one by
    default."""
    ids = ", ids array<int>" if with_ids else ""
    pieces = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                    .mapInArrow(gives_back(_pieces(size, vocabulary, with_ids), keeps=CACHE),
                                "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ids), "pack-pieces")
    full = pieces.filter(F.col("length") == size).select(
        "uid", (F.col("uid") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < size).select("uid", "length")
    placed = [full]
    turn = 0
    while True:
        turn += 1
        n = rest.count()
        groups = max(1, -(-n // GROUP))
        out = staged(rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
                     .groupBy("grp").applyInPandas(_pack(size, turn, groups == 1),
                                                   "uid long, length long, sequence_id long, offset long, done boolean"), "pack-round")
        placed.append(out.filter("done").select("uid", "sequence_id", "offset"))
        if groups == 1:
            break
        rest = out.filter(~F.col("done")).select("uid", "length")
    places = placed[0]
    for part in placed[1:]:
        places = places.unionByName(part)
    return pieces.join(places, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences of ``pack(..., with_ids=True)``, each at most one
    sequence long."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p")["ids"]).alias("ids")))
