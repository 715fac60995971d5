"""Operator 7: exact Jaccard self-join of word-shingle sets by universe partitioning.

Two sets of sizes ``n`` and ``n'`` with Jaccard >= num/den differ in at most
``H = floor((den - num) * (n + n') / (den + num))`` elements.  Sizes are cut into bands; the sets
that can meet with the larger one in band ``j`` share one *layout*: ``m`` segments (elements are
hashed into them), the first ``d`` of which also index their one-deletion neighbourhoods.  An
equal segment accounts for one unit, a segment matched up to one deletion for two, so with
``m + d > H`` some indexed signature is shared by every qualifying pair (pigeonhole).

The allocation is cost-based.  ``m`` and ``d`` minimise rows emitted plus the expected price of
empty segments, which every set would share, and of one-element segments, which sets with a common
passage share.  A set leaves out its smallest segments as long as the units of the others exceed
``H`` (a deletion segment counts two units with three elements or more, one with two, none below).
Of two similar sets, the one that leaves out more satisfies the pigeonhole with its own segments,
and the other one indexes these too, since a shared segment has the same size in both.

A signature's holders are candidates.  A very frequent signature is spread over tasks and cut into
blocks; in the first pass a block meets itself and its group's first block only, which connects
copies in a number of block pairs linear in the group.  Groups that are one component then are done; in the
others the second pass compares all blocks.  Holders are never expanded into all pairs: a parity bitmap
of each set bounds the true difference from below and drops pairs that cannot qualify, pairs already
connected are skipped, and only the rest is verified exactly on the whole texts.

Defined cases: null, empty and blank texts have the empty set, link with nothing and are their own
component; equal texts, repeated rows and repeated ids are collapsed first; rows with a null id
take part, and a component's id is the smallest id that is not null (null if it has none).  Only
the id and text columns are read, so any other columns may exist.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import components, free_name, staged
from hrlens.llm.textkit import SLICE_BYTES, U, gives_back, long_list, mix, shingle_sets, slices

BAND_RATIO = 1.5
EMPTY_PRICE = 100.0  # rows that one indexed empty segment is taken to cost
THIN_PRICE = 5.0      # the same for a one-element segment
SMALLEST = 3          # segments of so many elements are indexed in any case
BROADCAST_KEYS = 200_000  # of 32 characters
BLOCK = 1024        # members of a signature's group that one task compares with one another
HELD = 1 << 16      # holders of one signature that a task keeps before it sends them on
TASK_BITS = 24      # block numbers of cut groups carry the task above so many bits
NEAREST = 3         # partners that a member asks for in the first pass, in each of its ...
ASKED = 2           # ... largest groups


def max_difference(n1: int, n2: int, num: int, den: int) -> int:
    return (den - num) * (n1 + n2) // (den + num)


@lru_cache(maxsize=None)
def band_edges(num: int, den: int, top: int = 1 << 31) -> tuple[int, ...]:
    """Lower sizes of the bands; each band is at least as wide as the size ratio of a pair."""
    ratio = max(BAND_RATIO, den / num)
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
    return tuple(edges)


def _chance(n: int, m: int) -> tuple[float, float, float]:
    """Chances that a segment of a set of ``n`` elements has 0, 1 and 2 of them."""
    if m == 1:
        return float(n == 0), float(n == 1), float(n == 2)
    p0 = (1 - 1 / m) ** n
    return p0, n * p0 / (m - 1), n * (n - 1) / 2 * p0 / (m - 1) ** 2


def _short(mean: float, var: float, h: int) -> float:
    """Chance (normal approximation) that units with this mean and variance do not exceed ``h``."""
    return 0.5 * math.erfc((mean - h - 0.5) / math.sqrt(2 * var + 1e-9))


@lru_cache(maxsize=None)
def layout(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, segments with one-deletion neighbourhoods, H) for pairs whose larger set is in
    ``band``; H = 0 leaves only equal sets, which need a single segment."""
    edges = band_edges(num, den)
    low, high = edges[band], edges[band + 1] - 1
    h = max_difference(high, high, num, den)
    best = None
    for d in range(0, min(h + 1, 8) + 1):
        for extra in range(0, 61):
            m = h + 1 - d + (extra if h < 100 else extra * h // 100)
            if m < max(1, d):
                continue
            p0, p1, p2 = _chance(low, m)
            p3 = 1 - p0 - p1 - p2
            pair, pair_var = 2 * p3 + p2, 4 * p3 + p2 - (2 * p3 + p2) ** 2
            units = lambda p: ((m - d) * p + d * pair, (m - d) * p * (1 - p) + d * pair_var)  # noqa: B023, E731
            cost = (m + d * high / m + EMPTY_PRICE * m * p0 * _short(*units(1 - p0), h)
                    + THIN_PRICE * m * p1 * _short(*units(1 - p0 - p1), h))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, m, d)
    return best[1], best[2], h


def _signatures(n: np.ndarray, h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of all sets; ``h`` holds the sorted elements of set 0, 1, ..."""
    edges = np.asarray(band_edges(num, den), np.int64)
    sets = np.flatnonzero(n > 0)
    own = np.searchsorted(edges, n[sets], side="right") - 1
    up = n[sets] * den >= num * edges[own + 1]
    who = np.concatenate((sets, sets[up]))
    band = np.concatenate((own, own[up] + 1))
    start = np.cumsum(n) - n
    owners, sigs = [], []
    for b in np.unique(band):
        m, d, diff = layout(int(b), num, den)
        ids = who[band == b]
        size = n[ids]
        rep = np.repeat(np.arange(len(ids)), size)
        at = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[ids], size)
        e = h[at]
        seg = ((mix(e + U(7)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        g = mix(e + U(13))
        flat = rep * m + seg
        order = np.argsort(flat, kind="stable")
        total = np.zeros(len(ids) * m, U)
        count = np.bincount(flat, minlength=len(ids) * m)
        full = np.flatnonzero(count)
        total[full] = np.add.reduceat(g[order], np.concatenate(([0], np.cumsum(count[full])[:-1])))
        salt = mix(np.arange(m, dtype=U) + U(int(b) << 32))
        held = count.reshape(-1, m)
        plain = held[:, d:]
        pair = 2 * (held[:, :d] >= 3).sum(1) + (held[:, :d] == 2).sum(1)
        least = np.zeros(len(ids), np.int64)  # the smallest segment that is indexed
        for c in range(1, SMALLEST + 1):
            least[(plain >= c).sum(1) + pair > diff] = c
        use = held >= least[:, None]
        use[:, :d] = (held[:, :d] >= 2) | (least == 0)[:, None]
        use = use.ravel()
        owner = np.repeat(np.arange(len(ids)), m)
        owners.append(ids[owner[use]])
        sigs.append(mix(total[use] + np.tile(salt, len(ids))[use]))
        if d:
            one = (seg < d) & ((count[flat] >= 3) | (least[rep] == 0))
            owners.append(ids[rep[one]])
            sigs.append(mix(total[flat[one]] - g[one] + salt[seg[one]]))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, U)
    owner, sig = np.concatenate(owners), np.concatenate(sigs)
    order = np.argsort(owner, kind="stable")
    return owner[order], sig[order]


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Width of a set's parity bitmap: the power of two at or above ``2 n`` for small sets and
    ``0.75 n`` for large ones.  Unrelated sets then differ in well over H bits."""
    return 2 ** np.ceil(np.log2(np.maximum(np.minimum(2 * n, 512), np.maximum(0.75 * n, 64)))).astype(np.int64)


def _bitmaps(n: np.ndarray, doc: np.ndarray, h: np.ndarray) -> list[bytes]:
    bits = bitmap_bits(n)
    base = np.cumsum(bits) - bits
    where = base[doc] + (mix(h + U(29)) & (bits[doc] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(where, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    a = base // 8
    return [packed[i:i + w // 8] if k else b"" for i, w, k in zip(a.tolist(), bits.tolist(), n.tolist())]


def _describe(k: int, num: int, den: int, arrow_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        first: dict[bytes, int] = {}
        for batch in batches:
            for s in slices(batch["text"]):
                doc, h = shingle_sets(s, k)
                n = np.bincount(doc, minlength=s.n)
                b = np.cumsum(n)
                key = np.zeros((s.n, 2), U)
                full = np.flatnonzero(n)
                if len(full):
                    key[full, 0] = np.add.reduceat(mix(h + U(101)), (b - n)[full])
                    key[full, 1] = np.add.reduceat(mix(h + U(211)), (b - n)[full])
                uids = np.arange(uid, uid + s.n)
                uid += s.n
                rep = uids.copy()
                for i in full.tolist():
                    rep[i] = first.setdefault(key[i].tobytes(), int(uids[i]))
                if len(first) > 200_000:
                    first.clear()
                new = rep == uids
                keep = new[doc]
                own = np.where(new, n, 0)
                owner, sig = _signatures(own, h[keep], num, den)
                maps = _bitmaps(own, doc[keep], h[keep])
                rows = slice(s.first, s.first + s.n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(uids), batch["doc_id"][rows], batch["tkey"][rows], pa.array(n.astype(np.int64)),
                    pa.array(rep), long_list(sig, np.bincount(owner, minlength=s.n)),
                    pa.array(maps, pa.binary())], schema=arrow_schema)
    return run


def _groups(block: int, held: int):
    """Rows dealt by ranges of (signature, uid) and sorted -> (grp, blk, size, cut, uid) of every
    signature with two holders or more, in blocks of ``block`` holders.

    Groups with the same holders get the same ``grp`` and are emitted once per task.  The first and the
    last signature of a task may have holders in other tasks, and one with more than ``held`` holders
    is not kept: their holders go out as they come, marked as ``cut``, under the signature as name
    and with block numbers of this task; ``size`` is then the number sent so far.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "blk", "size", "cut", "uid"]
        place = TaskContext.get().partitionId() + 1 << TASK_BITS
        seen: set[tuple] = set()
        sent = 0

        def whole(sig: np.ndarray, uid: np.ndarray) -> list[np.ndarray]:
            cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
            size = np.diff(cut)
            many = size > 1
            if not many.any():
                return []
            keep = np.repeat(many, size)
            u = uid[keep]
            starts = np.concatenate(([0], np.cumsum(size[many])))
            name = mix(np.add.reduceat(mix(u.view(U) + U(3)), starts[:-1])).view(np.int64)
            local = np.repeat(np.arange(len(name)), size[many])
            blk = (np.arange(len(u)) - np.repeat(starts[:-1], size[many])) // block
            fresh = np.array([x not in seen for x in name.tolist()])
            seen.update(name[fresh].tolist())
            if len(seen) > 300_000:
                seen.clear()
            use = fresh[local]
            return [name[local][use], blk[use], size[many][local][use], np.zeros(int(use.sum()), bool), u[use]]

        def part(sig: int, uid: np.ndarray) -> list[np.ndarray]:
            nonlocal sent
            n = len(uid)
            blk = place + (sent + np.arange(n)) // block
            sent += n
            return [np.full(n, sig), blk, np.full(n, sent), np.ones(n, bool), uid]

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if cols and len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

        none = np.zeros(0, np.int64)
        held_s, held_u = none, none  # holders of the last signature so far
        going = before = None        # signature whose holders go out as they come; last row
        for batch in batches:
            s, u = (batch[c].to_numpy(zero_copy_only=False) for c in ("sig", "uid"))
            if not len(s):
                continue
            if before is None:
                going = s[0]
            new = np.concatenate(([before != (s[0], u[0])], (s[1:] != s[:-1]) | (u[1:] != u[:-1])))
            before = (s[-1], u[-1])
            s, u = np.concatenate((held_s, s[new])), np.concatenate((held_u, u[new]))
            held_s, held_u = none, none
            if going is not None:
                lead = int(np.searchsorted(s, going, side="right"))
                yield from out(part(going, u[:lead]))
                s, u = s[lead:], u[lead:]
                if not len(s):
                    continue
                going, sent = None, 0
            cut = int(np.searchsorted(s, s[-1]))
            if cut:
                yield from out(whole(s[:cut], u[:cut]))
            held_s, held_u = s[cut:], u[cut:]
            if len(held_s) > held:
                going = held_s[0]
                yield from out(part(going, held_u))
                held_s, held_u = none, none
        if len(held_s):
            yield from out(part(held_s[0], held_u))
    return run


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _near_pairs(num: int, den: int, nearest: int | None):
    """Rows sorted by (grp, b1, b2) -> candidate pairs (a, b) that the bitmaps can't rule out.

    ``nearest``: only that many partners per asking member (those with the smallest lower bound);
    None: all that remain.  Members with the same ``root`` are never paired.
    """
    def pairs(rows: list[np.ndarray], maps: list[bytes], b1: int, b2: int) -> tuple[np.ndarray, np.ndarray]:
        uid, blk, n, root, asks = rows
        words = np.array([len(x) // 8 for x in maps])
        a_out, b_out = [], []
        for w in np.unique(words):
            # members with this width against those at least as wide, folded to it
            left = np.flatnonzero((words == w) & asks)
            right = np.flatnonzero(words >= w)
            if not len(left):
                continue
            fold = np.stack([_fold(np.frombuffer(maps[i], U), w) for i in right])
            mine = np.stack([np.frombuffer(maps[i], U) for i in left])
            for x, i in enumerate(left):
                ok = (root[right] != root[i]) & (blk[i] == (b1 if b1 == b2 else np.where(blk[right] == b1, b2, b1)))
                ok &= (words[right] > w) | (uid[right] > uid[i]) if nearest is None else (right != i)
                ok &= np.minimum(n[right], n[i]) * den >= np.maximum(n[right], n[i]) * num
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                diff = np.bitwise_count(fold[at] ^ mine[x]).sum(1, dtype=np.int64)
                fit = diff * (den + num) <= (den - num) * (n[right[at]] + n[i])
                at, diff = at[fit], diff[fit]
                if nearest is not None and len(at) > nearest:
                    at = at[np.lexsort((uid[right[at]], diff))[:nearest]]
                a_out.append(np.full(len(at), uid[i]))
                b_out.append(uid[right[at]])
        if not a_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table[c].to_numpy() for c in ("grp", "b1", "b2", "uid", "blk", "n", "root", "asks")]
            maps = table["map"].to_pylist()
            g, b1, b2 = cols[:3]
            cut = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]), [True])))
            outs = [pairs([c[i:j] for c in cols[3:]], maps[i:j], int(b1[i]), int(b2[i]))
                    for i, j in zip(cut[:-1], cut[1:]) if j - i > 1]
            a = np.concatenate([x[0] for x in outs] or [np.zeros(0, np.int64)])
            b = np.concatenate([x[1] for x in outs] or [np.zeros(0, np.int64)])
            if len(a):
                both = np.unique(np.stack((a, b), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            g, b1, b2 = (table[c].to_numpy() for c in ("grp", "b1", "b2"))
            last = np.flatnonzero((g != g[-1]) | (b1 != b1[-1]) | (b2 != b2[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit(table.slice(0, cut).combine_chunks())
            tail = table.slice(cut)
        if tail is not None and tail.num_rows:
            yield from emit(tail.combine_chunks())
    return run


def _shares(texts: pa.Array, k: int, num: int, den: int) -> Iterator[bool]:
    """Whether texts 0 and 1, 2 and 3, ... have similar shingle sets."""
    held: list[np.ndarray] = []
    for s in slices(texts):
        doc, h = shingle_sets(s, k)
        n = np.bincount(doc, minlength=s.n)
        e = np.cumsum(n)
        held += [h[i:j] for i, j in zip(e - n, e)]
        while len(held) >= 2:
            x, y = held[0], held[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            yield both > 0 and den * both >= num * (len(x) + len(y) - both)
            held = held[2:]


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok: list[bool] = []
            # runs of pairs of a bounded size, so that only these are copied side by side
            upto = np.cumsum(pc.binary_length(batch["ta"]).to_numpy().astype(np.int64) + pc.binary_length(batch["tb"]).to_numpy())
            while len(ok) < batch.num_rows:
                i = len(ok)
                done = int(upto[i - 1]) if i else 0
                n = max(1, int(np.searchsorted(upto, done + SLICE_BYTES, side="right")) - i)
                texts = pa.concat_arrays([batch[c].slice(i, n).cast(pa.large_string()) for c in ("ta", "tb")])
                ok += _shares(texts.take(pa.array(np.arange(2 * n).reshape(2, -1).T.ravel())), k, num, den)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "linked"])
    return run


def _checked(keys: DataFrame) -> DataFrame:
    """A table of keys, marked for broadcast if it has at most ``BROADCAST_KEYS`` rows; beyond that the
    join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _order() -> Column:
    """By id, rows without one last, then by the text's md5."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.coalesce("tkey", F.lit("")).alias("tkey"))


def _resolve(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per input row: doc_id, tkey (md5 of the text), n_shingles, root, component_id, links, and
    ``first``, the smallest id and text of the component (``_order``)."""
    arrow = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.string()), ("n", pa.int64()),
                       ("rep", pa.int64()), ("sigs", pa.list_(pa.int64())), ("map", pa.binary())])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col)).alias("tkey"),
                         F.col(text_col).cast("string").alias("text"))
    table = staged(source.mapInArrow(
        gives_back(_describe(k, num, den, arrow)),
        "uid long, doc_id long, tkey string, n long, rep long, sigs array<long>, map binary"), "ngram-sets")
    sigs = table.filter("uid = rep and n > 0").select(F.explode("sigs").alias("sig"), "uid")
    groups = staged(sigs.repartitionByRange("sig", "uid").sortWithinPartitions("sig", "uid")
                    .mapInArrow(gives_back(_groups(BLOCK, HELD)), "grp long, blk long, size long, cut boolean, uid long").distinct(), "ngram-groups")
    # block numbers of cut groups: a row per task and group, two a task besides very long groups
    runs = (groups.filter("cut").groupBy("grp", F.shiftright("blk", TASK_BITS).alias("task"))
            .agg(F.min("blk").alias("low"), F.max("blk").alias("high"), F.count("*").alias("n")))
    heads = runs.groupBy("grp").agg(F.min("low").alias("head"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    runs = _checked(staged(runs.join(heads, "grp").select("grp", "low", "high", "head"), "ngram-runs"))
    facts = table.filter("uid = rep and n > 0").select("uid", "n", "map")
    member = facts.join(groups.select("uid").distinct(), "uid", "left_semi")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """``uid, text`` of the documents in ``pairs``, each text once."""
        uids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
        keys = staged(table.filter("uid = rep").select("uid", "tkey").join(uids, "uid", "left_semi"), "ngram-keys")
        wanted = _checked(keys.select("tkey").distinct())
        text = source.select("tkey", "text").join(wanted, "tkey", "left_semi").dropDuplicates(["tkey"])
        return staged(text.join(keys, "tkey").select("uid", "text"), "ngram-texts")

    def candidates(roots: DataFrame | None, nearest: int | None) -> DataFrame:
        if roots is None:
            # a set has no more groups than signatures
            mine = staged(groups.groupBy("uid").agg(
                F.slice(F.sort_array(F.collect_list(F.struct("size", "grp")), False), 1, ASKED)["grp"].alias("mine")), "ngram-asks")
            asked = mine.select(F.explode("mine").alias("grp")).distinct()
            rows = (groups.join(asked, "grp", "left_semi").join(mine, "uid").withColumn("asks", F.array_contains("mine", F.col("grp"))).drop("mine")
                    .join(member, "uid").withColumn("root", F.col("uid")))
        else:
            rows = groups.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
            open_groups = (rows.groupBy("grp").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
                           .filter("r0 <> r1").select("grp"))
            rows = rows.join(open_groups, "grp", "left_semi").withColumn("asks", F.lit(True)).join(member, "uid")
        high = F.floor((F.col("size") - 1) / BLOCK)
        rows = (rows.join(runs, "grp", "left").filter("not cut or head is not null")
                .withColumn("head", F.coalesce("head", F.lit(0).cast("long")))
                .withColumn("other", F.explode(F.sequence(F.coalesce("low", F.lit(0).cast("long")), F.coalesce("high", high)))))
        if roots is None:
            rows = rows.filter("other = blk or other = head or blk = head")
        rows = rows.select(
            "grp", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"),
            "uid", "blk", "n", "root", "map", "asks")
        return (rows.repartition("grp", "b1", "b2").sortWithinPartitions("grp", "b1", "b2", "uid")
                .mapInArrow(gives_back(_near_pairs(num, den, nearest)), "a long, b long").distinct())

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = staged(pairs, f"{label}-pairs")
        texts = texts_of(pairs)
        both = (pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b"))
        return staged(both.mapInArrow(gives_back(_verify(k, num, den)), "a long, b long, linked boolean"), label)

    first = verified(candidates(None, NEAREST), "ngram-first")
    roots = components(first.filter("linked").select("a", "b"), "ngram-cc")
    rest = candidates(roots, None).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = verified(rest, "ngram-rest").filter("linked").select("a", "b")
    links = first.filter("linked").select("a", "b").unionByName(second)
    # the second pass only adds links between components of the first
    across = (second.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
              .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    more = components(across, "ngram-cc2").select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = (roots.join(more, "root", "left").select(F.col("node").alias("rep"), F.coalesce("top", "root").alias("root"))
             .unionByName(more.select(F.col("root").alias("rep"), F.col("top").alias("root"))).dropDuplicates(["rep"]))
    rows = (table.select("doc_id", "tkey", "n", "rep").join(final, "rep", "left")
            .select("doc_id", "tkey", "n", F.coalesce("root", "rep").alias("root")))
    counted = (links.select(F.col("a").alias("rep")).join(final, "rep", "left")
               .groupBy(F.coalesce("root", "rep").alias("root")).agg(F.count("*").alias("links")))
    smallest = (rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(_order()).alias("first"))
                .join(counted, "root", "left").select("root", "component_id", "first", F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    return (rows.join(smallest, "root")
            .select("doc_id", "tkey", F.col("n").alias("n_shingles"), "root", "component_id", "links", "first"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` and ``links`` = the number of
    verified links that joined the component's distinct texts.

    Documents link when the Jaccard similarity of their distinct ``k``-word shingles is at least
    ``num / den``; components are those of the whole link graph.
    """
    return _resolve(docs, k, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id", "links")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when every component keeps one document: the text with its
    smallest id (several texts under that id: the smallest md5), or without any id the text with the
    smallest md5.  Every text is judged by itself, also where ids repeat; rows that are equal in id
    and text stay once."""
    parts = staged(_resolve(docs, k, num, den, id_col, text_col), "ngram-parts")
    who, what = free_name(docs, "gone_id"), free_name(docs, "gone_text")
    keys = parts.select(F.col("doc_id").alias(who), F.coalesce("tkey", F.lit("")).alias(what), (_order() == F.col("first")).alias("stays"))
    key, text = F.col(id_col).cast("long"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))
    same = key.eqNullSafe(F.col(who)) & (text == F.col(what))
    # dropped and repeated documents are few beside the others
    gone = keys.filter("not stays").select(who, what).distinct()
    again = keys.filter("stays").groupBy(who, what).count().filter("count > 1").select(who, what)
    if again.isEmpty():
        return docs.join(_checked(gone), same, "left_anti")
    return (docs.join(_checked(gone.unionByName(again)), same, "left_anti")
            .unionByName(docs.join(_checked(again), same, "left_semi").dropDuplicates([id_col, text_col])))
