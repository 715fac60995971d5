"""The streaming scorer gives the same rows as the batch scorer on the same files."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from hrlens.operators import features as fe
from hrlens.operators import score as sc
from hrlens.plans import catalog as C
from hrlens.streaming.scoring import start_scoring


def test_stream_matches_batch(spark):
    o = C.O(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="hrlens-src-")
    sink = tempfile.mkdtemp(prefix="hrlens-sink-")
    o.repartition(3).write.mode("overwrite").parquet(src + "/in")
    state = fe.fit_feature_state(C.O_train(o))
    q = start_scoring(spark, src + "/in", o.schema, sink + "/out", "t1", state, C.SCORE_MODEL, "id",
                      C.INPUT_O, C.NOMINAL_IN)
    q.awaitTermination(120)
    got = spark.read.parquet(sink + "/out")
    assert got.count() == o.count()
    ok = got.filter(F.col("issues") == 0).drop("issues")
    batch = sc.prediction_frame(sc.predict_linear(fe.apply_features(o, state), C.SCORE_MODEL, "id"), "id")
    assert ok.exceptAll(batch).count() == 0
