"""Awkward rows that every document operator has to take."""
import pyspark.sql.types as T

#: names that operators use inside
EXTRA = ["row", "tkey", "uid", "goal", "mix", "found", "keep", "times", "hit", "key", "rep", "root", "size", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.IntegerType()) for c in EXTRA]])


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, s, None if t is None else len(t), *[7] * len(EXTRA)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "b"), (4, "one", "en", "b"),
            (None, "one", None, "b"), (None, None, None, None), (5, long, "en", "a"), (6, long, "en", None), (7, "1234 ## !!", "de", "c"),
            (8, "naïve é x \U0001f600 ́", "fr", "c"), (9, "a b c d e f g\n\n a b c d e f g\na b", "en", "c")]
