import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Extra columns whose names the operators could use inside.
CLASHES = ["id", "fp", "k", "key", "kept", "spans", "n", "_text", "_id", "_key", "_verdict", "block", "pass", "draw"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, clashes=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clashes:
            from pyspark.sql import functions as F
            for c in CLASHES:
                df = df.withColumn(c, F.lit("own"))
        return df
    return make
