"""The registered queries of the operators: each applies one operator, with
production parameters, to its whole table. `ORACLE` holds DuckDB SQL where SQL
can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm import (best_fit, decontaminate_sw, fill_in_middle, mixing, perspectives, pseudo_likelihood, quality_gbt,
                            secrets_trigram, simhash_gray, suffix_repeats, trie_codes, url_vocabulary, warc_zstd)
from ticketlake.llm.oracle import ORACLE  # noqa: F401  (registered next to the queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality_gbt.verdicts(F.col("text"), model).alias("v")).select("doc_id", "v.*")


@register
def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register
def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = perspectives.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return got.withColumnRenamed("conv", "conv_id").withColumn("mask", mask)


@register
def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.removals(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register
def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_zstd.archive_and_read(table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_gray.classes(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), simhash_gray.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


@register
def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_vocabulary.judge(F.col("url")).alias("j")).select("page_id", "j.*")


@register
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register
def op9_decontaminate_sw(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate_sw.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@register
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets_trigram.scan(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array(*[F.lit(r.kind) for r in secrets_trigram.BASE_RULES])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(
        F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda x: F.array_contains(base, x["kind"])), one), ","), 256)
         .alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"))


@register
def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trie_codes.compress(table(spark, sf_dir, "embeddings"))
    return got.withColumnsRenamed({"id": "vec_id", "group_error": "label_error"})


@register
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", fill_in_middle.transform(F.col("text"), F.col("doc_id")).alias("f")).select("doc_id", "f.*")
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register
def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
