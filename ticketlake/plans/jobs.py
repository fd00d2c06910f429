"""End-to-end batch jobs with Parquet between stages (L1, L3, K15)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators import intent as I
from ticketlake.operators import kb as K
from ticketlake.operators import sampling as SM
from ticketlake.operators import metrics as M
from ticketlake.operators import quality as Q
from ticketlake.operators import threads as TH
from ticketlake.plans import kb_store as KS
from ticketlake.plans import pipeline as P
from ticketlake.session import scratch_tables
from ticketlake.sources import tables as S


SAMPLE_ROWS = 5000
FIRST_DOCUMENTS = 100


def build_kb(spark: SparkSession, sf_dir: str, out: str, source: str = "conversations", brand: str = P.BRAND) -> dict[str, str]:
    """Conversations -> processed (masked, reasons) -> labelled -> cases ->
    index metadata, each written as Parquet; cases partitioned by intent so an
    intent pre-filter prunes partitions. They are then published as the current
    version of the store (vectors, TF-IDF index, encoder; `kb_store`). `source="threads"`
    rebuilds the conversations of `brand` from the tweets first. The valid
    conversations are also written as a seeded sample of 5,000."""
    paths = {n: f"{out}/{n}" for n in ("conversations", "processed", "processed_sample", "removal_report", "cases",
                                       "index_metadata", "store", "taxonomy_json", "documents_json")}
    conv = P.clean(spark, sf_dir) if source == "conversations" else \
        TH.clean_conversations(P.thread_conversations(spark, sf_dir, brand))
    S.write_parquet(conv, paths["conversations"])
    proc = Q.processed_conversations(spark.read.parquet(paths["conversations"]))
    S.write_parquet(proc, paths["processed"])
    proc = spark.read.parquet(paths["processed"])
    S.write_parquet(Q.removal_report(proc), paths["removal_report"])
    lab = I.label_table(proc.filter("is_valid").drop("reason", "is_valid"), "customer_problem", "intent")
    S.write_parquet(K.build_cases(lab), paths["cases"], partition_by=["intent"])
    S.write_parquet(SM.seeded_sample(proc.filter("is_valid"), "conversation_id", SAMPLE_ROWS), paths["processed_sample"])
    cases = spark.read.parquet(paths["cases"])
    S.write_parquet(K.index_metadata(cases), paths["index_metadata"])
    with scratch_tables(spark):
        KS.publish(cases, paths["store"])
    write_json_files(cases, paths)
    return paths


def write_json_files(cases: DataFrame, paths: dict[str, str]) -> None:
    """The taxonomy (a record an intent: definition, examples, the intents it is
    confused with) and the documents of the first hundred cases."""
    few = I.label_examples(cases, key="case_id").withColumnRenamed("examples", "own")
    taxonomy = I.taxonomy_frame(cases.sparkSession).join(few, "intent", "left").withColumn("examples", F.coalesce("own", "examples")).drop("own")
    S.write_json(taxonomy.coalesce(1), paths["taxonomy_json"])
    first = cases.orderBy("case_id").limit(FIRST_DOCUMENTS).select("case_id", K.document_text().alias("document"))
    S.write_json(first.coalesce(1), paths["documents_json"])


def write_golden_set(golden: DataFrame, out: str) -> dict[str, str]:
    """The golden examples as CSV and as JSON lines."""
    paths = {"csv": f"{out}/golden_csv", "json": f"{out}/golden_json"}
    S.write_csv(golden, paths["csv"])
    S.write_json(golden, paths["json"])
    return paths


def triage_job(spark: SparkSession, sf_dir: str, out: str, kb: dict[str, str] | None = None) -> str:
    """Batch triage of every message; records written as JSON lines. `kb` are
    the paths that `build_kb` returned: the current version of its store is
    read."""
    now = KS.load(spark, kb["store"]) if kb else None
    cases, index = (now.cases, now.index) if now else (None, None)
    with scratch_tables(spark):
        rec = P.record(P.triage_all(spark, sf_dir, cases, index))
        rec.select("json").write.mode("overwrite").text(f"{out}/records")
    return f"{out}/records"


def metrics_report(spark: SparkSession, pred_table, routing_table, provider: str = "keyword",
                   elapsed_seconds: float | None = None, retrieval=None, response_quality=None) -> str:
    """Nested metrics JSON: provider, intent, retrieval, response quality,
    routing, elapsed. The inputs are grouped results of a few rows (a row a
    label, or one), so the document is built on the driver."""
    one = lambda df: None if df is None else df.first().asDict()
    return json.dumps({"provider": provider,
                       "intent_classification": [r.asDict() for r in M.summary(M.per_label(pred_table)).collect()],
                       "retrieval": one(retrieval), "response_quality": one(response_quality),
                       "routing": one(M.agreement(routing_table)), "elapsed_seconds": elapsed_seconds}, default=str)
