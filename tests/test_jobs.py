"""Batch jobs, file formats and written indexes."""
import json

from pyspark.sql import functions as F

from ticketlake.operators import intent as I
from ticketlake.operators import vectors as V
from ticketlake.plans import jobs
from ticketlake.plans import kb_store as KS
from ticketlake.plans import pipeline as P
from ticketlake.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_knowledge_base_from_threads_and_its_index(spark, tmp_path):
    paths = jobs.build_kb(spark, SF, str(tmp_path), source="threads")
    cases = spark.read.parquet(paths["cases"])
    want = {r.case_id for r in P.thread_cases(spark, SF).select("case_id").collect()}
    assert want and {r.case_id for r in cases.select("case_id").collect()} == want
    assert spark.read.parquet(paths["processed_sample"]).count() == cases.count()
    meta = spark.read.parquet(paths["index_metadata"])
    assert meta.columns == ["case_id", "conversation_id", "intent", "resolution_quality", "turn_count"] and meta.count() == len(want)
    index = KS.load(spark, paths["store"]).index
    assert KS.load(spark, paths["store"]).cases.count() == cases.count()
    tax = spark.read.json(paths["taxonomy_json"])
    assert set(tax.columns) == {"intent", "definition", "examples", "confusing_with"} and tax.count() == 12
    first = [r.case_id for r in spark.read.json(paths["documents_json"]).collect()]
    assert first == sorted(want)[:100]
    cls = P.classified(cases.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message")))
    key = ["message_id", "case_id", "retrieval_rank"]
    a, b = ({tuple(r) for r in P.retrieved(cls, cases, index=i).select(*key).collect()} for i in (index, None))
    assert a == b
    out = jobs.triage_job(spark, SF, str(tmp_path / "triage"), kb=paths)
    assert spark.read.text(out).count() == cases.count()


def test_golden_files_round_trip(spark, tmp_path):
    rows = [("001", 'a "quoted"\nline, with comma', "complaint", "n", "", "r", "hard", 3), ("002", "plain", "refund_issue", "n", "", "r", "easy", 2)]
    golden = spark.createDataFrame(rows, "example_id string, customer_message string, intent string, intent_notes string, "
                                         "expected_action string, reference_response string, difficulty string, turn_count long")
    paths = jobs.write_golden_set(golden, str(tmp_path))
    js = S.read_typed(spark, paths["json"], S.GOLDEN_COLUMNS, "json").orderBy("example_id").collect()
    cs = S.read_typed(spark, paths["csv"], S.GOLDEN_COLUMNS, "csv").orderBy("example_id").collect()
    assert [tuple(r) for r in js] == rows
    assert [r.customer_message for r in cs] == [r[1] for r in rows] and cs[0].expected_action == "auto_handle"


def test_absent_columns_take_defaults(spark, tmp_path):
    spark.createDataFrame([("C1", "x"), ("C2", None)], "case_id string, customer_problem string").write.parquet(str(tmp_path / "c"))
    got = S.read_typed(spark, str(tmp_path / "c"), S.CASE_COLUMNS, "parquet").orderBy("case_id").collect()
    assert [(r.intent, r.resolution_quality, r.turn_count, r.customer_problem) for r in got] == [
        ("general_inquiry", "weak", 2, "x"), ("general_inquiry", "weak", 2, "")]


def test_report_has_all_sections(spark):
    pred = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a")], "model string, truth string, pred string")
    routing = spark.createDataFrame([("auto_handle", "auto_handle"), ("escalate", "auto_handle")], "truth string, pred string")
    extra = spark.createDataFrame([(0.5, 0.25)], "recall_at_5 double, mrr double")
    got = json.loads(jobs.metrics_report(spark, pred, routing, elapsed_seconds=1.0, retrieval=extra, response_quality=extra))
    assert list(got) == ["provider", "intent_classification", "retrieval", "response_quality", "routing", "elapsed_seconds"]
    assert got["retrieval"]["mrr"] == 0.25


def test_examples_per_label(spark):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(20)], "conversation_id long, customer_problem string, intent string")
    got = {r.intent: r.examples for r in I.label_examples(df, 3).collect()}
    assert set(got) == {"a", "b"} and all(len(v) == 3 and all(int(t[1:]) % 2 == (k == "b") for t in v) for k, v in got.items())



def test_featurizer_hook(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, raw array<double>")
    by_name = V.embed(df, "raw").select("vec").collect()
    by_function = V.embed(df, lambda x: x.withColumn("vec", F.col("raw"))).select("vec").collect()
    assert by_name == by_function
