"""The knowledge base as one dataset with versions.

A version is a folder of Parquet tables: `cases` (every case with its metadata
and its dense vector, partitioned by intent), the parts of the TF-IDF index, and
the numbers of the text encoder. A version is written completely and never
changed; the file CURRENT names the one in use and is replaced by a rename, so a
reader sees the old version or the new one, never a part of either. A filter or a
join on the intent reads only the folders of the intents that it needs.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators import encoder as E
from ticketlake.operators import vectors as V
from ticketlake.operators.kb import document_text
from ticketlake.operators.postings import Index, build_index
from ticketlake.sources import tables as S


# ------------------------------------------------------------ the version file

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def set_current(spark: SparkSession, base: str, version: str) -> None:
    """Point CURRENT to a version: a new file takes the old one's name."""
    new, fs = _fs(spark, f"{base}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _fs(spark, f"{base}/CURRENT")[0], how)


def current(spark: SparkSession, base: str) -> str | None:
    """The version in use, or none."""
    p, fs = _fs(spark, f"{base}/CURRENT")
    return spark.read.text(f"{base}/CURRENT").first()[0] if fs.exists(p) else None


# ------------------------------------------------------------------- versions

def _write_index(index: Index, at: str) -> None:
    for name, t in index.tables().items():
        S.write_parquet(t, f"{at}/{name}")
    S.write_parquet(index.vectors.sparkSession.createDataFrame([(index.n_docs,)], "n_docs long"), f"{at}/size")


def _read_index(spark: SparkSession, at: str) -> Index:
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    return Index(read("terms"), read("size").first()["n_docs"], read("vectors"), read("postings"), read("bounds"))


def _write_encoder(spark: SparkSession, e: E.Encoder, at: str) -> None:
    rows = [(i, float(w), [float(x) for x in b]) for i, (w, b) in enumerate(zip(e.idf, e.basis)) if w]
    S.write_parquet(spark.createDataFrame(rows, "b int, idf double, basis array<double>"), f"{at}/basis")
    one = [(len(e.idf), [float(x) for x in e.strength], e.ngram_max)]
    S.write_parquet(spark.createDataFrame(one, "buckets int, strength array<double>, ngram_max int"), f"{at}/shape")


def _read_encoder(spark: SparkSession, at: str) -> E.Encoder:
    """At most a row a bucket."""
    shape = spark.read.parquet(f"{at}/shape").first()
    idf, basis = np.zeros(shape["buckets"]), np.zeros((shape["buckets"], len(shape["strength"])))
    for r in spark.read.parquet(f"{at}/basis").toLocalIterator():
        idf[r["b"]], basis[r["b"]] = r["idf"], r["basis"]
    return E.Encoder(idf, basis, np.array(shape["strength"]), shape["ngram_max"])


class Version:
    """One version, read lazily."""

    def __init__(self, spark: SparkSession, base: str, name: str):
        self.spark, self.name, self.at = spark, name, f"{base}/versions/{name}"

    @property
    def cases(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/cases")

    @property
    def index(self) -> Index:
        return _read_index(self.spark, f"{self.at}/tfidf")

    @property
    def encoder(self) -> E.Encoder:
        return _read_encoder(self.spark, f"{self.at}/encoder")


def publish(cases: DataFrame, base: str, *, dense: bool = True, rank: int = 32, buckets: int = 16_384) -> Version:
    """Write a version from case rows and make it the current one. `dense`
    adds the encoder and every case's vector; both may be left out where only
    TF-IDF retrieval is wanted."""
    spark, name = cases.sparkSession, uuid.uuid4().hex
    at = f"{base}/versions/{name}"
    rows = cases
    if dense:
        docs = cases.withColumn("document", document_text())
        enc = E.fit(docs, "document", rank=rank, buckets=buckets)
        _write_encoder(spark, enc, f"{at}/encoder")
        rows = E.encode(docs, "document", enc, "vector").drop("document")
    S.write_parquet(rows, f"{at}/cases", partition_by=["intent"])
    _write_index(build_index(cases, "case_id", "customer_problem"), f"{at}/tfidf")
    set_current(spark, base, name)
    return Version(spark, base, name)


def load(spark: SparkSession, base: str) -> Version:
    """The current version."""
    name = current(spark, base)
    if name is None:
        raise FileNotFoundError(f"no version of a knowledge base in {base}")
    return Version(spark, base, name)


# ------------------------------------------------------------------ retrieval

def similar_cases(version: Version, messages: DataFrame, *, key: str = "message_id", text: str = "message", k: int = 10,
                  intent: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(message_id, case_id, retrieval_rank, similarity_score): the nearest
    cases by the encoder's vectors; with `intent`, among the cases of the
    message's own intent, and only their folders are read."""
    q = E.encode(messages, text, version.encoder).select(F.col(key).alias("id"), "vec", *([F.col(intent).alias("intent")] if intent else []))
    c = version.cases.select(F.col("case_id").alias("id"), F.col("vector").alias("vec"), "intent")
    if intent:
        # the folders of other intents are not read (intents are few; the bound is checked)
        wanted = [r["intent"] for r in q.select("intent").where("intent IS NOT NULL").distinct().limit(1001).collect()]
        c = c.where(F.col("intent").isin(wanted)) if len(wanted) <= 1000 else c
    hits = V.block_topk(q, c, k, part="intent" if intent else None, exclude_self=exclude_self, q_name=key, c_name="case_id")
    return hits.withColumnsRenamed({"rank": "retrieval_rank", "score": "similarity_score"})
