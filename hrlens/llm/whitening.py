"""Operator 13: whitening of embeddings with distributed block matrices (Spark MLlib).

Every entry ``c`` becomes the whole number ``floor(1024 c) + 100000``, so sums per dimension are exact.
Centred rows get dense row numbers and become an ``IndexedRowMatrix``, cut into a ``BlockMatrix`` of
``ROWS`` rows a block.  The transpose times the matrix is the scatter; its product runs over many
partitions (``MID`` blocks each) whose partial sums are added, so no task sees the matrix.  The
scatter (dimensions squared) is decomposed on the driver, and a second block product, with the
whitening matrix, projects all rows.

Defined cases: rows whose vector is null, empty, or holds a null, NaN, infinite entry or one beyond
2^40 are left out, and so are rows of another length than the most frequent one (ties: the longer),
since they share no space with the others; null, repeated or tied ids do not matter, each remaining
row is in the result; a component without variance (constant dimensions, one row) has null whitened
values; an empty table gives no rows; only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hrlens.llm.store import staged

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
ROWS = 4096            # rows of a block
MID = 4                # row blocks that one task of the scatter product takes
FLAT = 1e-12           # a component with a smaller share of the largest variance has none
LARGEST = float(1 << 40)
BROADCAST_PARTS = 100_000
_IN_PART = (1 << 33) - 1


@dataclass
class Fit:
    """What whitening needs: rows, exact sums, eigenvalues (falling), eigenvectors as columns."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    widest: int   # no deviation is larger than this

    def usable(self, k: int) -> int:
        """Components among the first ``k`` that have variance."""
        v = self.values[:k]
        return int((v > FLAT * max(float(self.values[0]), 0.0)).sum()) if len(v) and self.values[0] > 0 else 0


def _finite(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x, index``: the usable rows as whole numbers, numbered densely from 0."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(_finite(F.col("v")))
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    # written, so that a row's part and its place in it stay the same for all later reads
    rows = staged(rows.filter(F.size("v") == (most["dims"] if most else 0))
                  .select("vec_id", x.alias("x"), F.monotonically_increasing_id().alias("place")), "whiten-rows")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the scan
    parts = staged(rows.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "whiten-parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return (rows.withColumn("part", part).join(parts, "part")
            .select("vec_id", "x", (F.col("base") + F.col("place").bitwiseAND(F.lit(_IN_PART))).alias("index")))


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Block product whose inner dimension is dealt over ``splits`` tasks a result block (Python's
    own ``multiply`` leaves that setting at 1, which would put a tall matrix into one task)."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _blocks(rows: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """Centred rows as a block matrix of one block column."""
    total = F.array(*[F.lit(s) for s in sums])
    centred = F.transform("x", lambda v, i: (v * n - F.get(total, i)).cast("double") / float(n))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, len(sums)).toBlockMatrix(ROWS, len(sums))


def _splits(n: int) -> int:
    return max(1, -(-n // (ROWS * MID)))


def fit(rows: DataFrame) -> tuple[Fit, BlockMatrix] | None:
    """The exact sums and the eigenvectors of the covariance of ``whole_vectors`` rows, and the
    centred rows as blocks; none for an empty table."""
    n = rows.count()
    if not n:
        return None
    dims = (rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos")
            .agg(F.sum("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("pos").collect())  # one row a dimension
    sums = [r["s"] for r in dims]
    widest = sum(max(n * r["high"] - r["s"], r["s"] - n * r["low"]) ** 2 for r in dims)
    centred = _blocks(rows, n, sums)
    scatter = _multiply(centred.transpose(), centred, _splits(n)).toLocalMatrix().toArray()
    cov = (scatter + scatter.T) / (2.0 * n)
    values, vectors = np.linalg.eigh(cov)
    return Fit(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(cov)), widest), centred


def project(centred: BlockMatrix, model: Fit, k: int, spark: SparkSession) -> DataFrame:
    """``index, z``: the whitened values of every row for its first ``k`` components."""
    by = model.vectors[:, :k] / np.sqrt(model.values[:k])
    local = DenseMatrix(by.shape[0], k, by.ravel(order="F"))
    whitener = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), by.shape[0], k)
    rows = _multiply(centred, whitener, 1).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return frame.select("index", vector_to_array("vector").alias("z"))


def identity_error(z: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` minus the identity, in one aggregate."""
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    row = z.agg(*[F.avg(F.col("z")[a]).alias(f"m{a}") for a in range(k)],
                *[F.avg(F.col("z")[a] * F.col("z")[b]).alias(f"c{a}_{b}") for a, b in cells]).first()
    return max((abs(row[f"c{a}_{b}"] - row[f"m{a}"] * row[f"m{b}"] - (a == b)) for a, b in cells), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    ``deviation`` is the sum over dimensions of ``(n x - S)^2``, exact as a decimal(38, 0);
    ``explained`` the component's share of the variance (null if there is none at all).
    """
    rows = whole_vectors(vectors, id_col, vec_col)
    got = fit(rows)
    kind = vectors.schema[id_col].dataType.simpleString()
    if got is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    model, centred = got
    top = min(components, len(model.sums))
    k = model.usable(top)
    error = 0.0
    if k:
        z = staged(project(centred, model, k, vectors.sparkSession), "whiten-projected")
        error = identity_error(z, k)
        rows = rows.join(z, "index")
    else:
        rows = rows.withColumn("z", F.array().cast("array<double>"))
    total = F.array(*[F.lit(s) for s in model.sums])
    kind = "decimal(38,0)" if model.widest >= 1 << 63 else "long"   # the sum is exact in both
    centre = F.transform("x", lambda v, i: (v * model.n - F.get(total, i)).cast("decimal(19,0)" if kind != "long" else kind))
    deviation = F.aggregate(centre, F.lit(0).cast(kind), lambda a, d: (a + d * d).cast(kind)).cast("decimal(38,0)")
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:top]]
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), (F.get("z", F.lit(j)) if j < k else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(share[j]).cast("double").alias("explained")) for j in range(top)])
    return (rows.select("vec_id", deviation.alias("deviation"), F.explode(parts).alias("c"))
            .select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
                    F.lit(float(error)).alias("identity_error")))
