"""Expectations written down by hand, from the rules and not from the
operators' formulas."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.functions import pii
from ticketlake.operators import intent as I
from ticketlake.operators import kb as K
from ticketlake.operators import models as MD
from ticketlake.operators import threads as TH
from ticketlake.operators import vectors as V
from ticketlake.operators.postings import tfidf_retrieve
from ticketlake.plans import pipeline as P

TWEET = "tweet_id string, author_id string, inbound boolean, in_response_to_tweet_id string, response_tweet_id string, text string"


def test_blank_ids_answer_nothing(spark):
    rows = [("1", "B", False, "", "", "r1"), ("2", "B", False, "", "", "r2"), ("", "c", True, "", "", "x"),
            ("", "d", True, "", "", "y"), ("", "e", True, "", "", "z"), ("3", "B", False, "4", "", "r3"), ("4", "c", True, "", "3", "q")]
    got = TH.reply_pairs(spark.createDataFrame(rows, TWEET), "B").collect()
    assert [(r.response_id, r.query_id, r.user_query, r.response) for r in got] == [("3", "4", "q", "r3")]


def test_repeated_ids_give_one_root_each(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else "") for i in range(9)]
    df = spark.createDataFrame(chain * 2 + [("n5", "")], "tweet_id string, in_response_to_tweet_id string")
    got = TH.thread_roots(df).collect()
    assert sorted((r.tweet_id, r.root_id) for r in got) == sorted((x, "n0") for x, _ in chain)


def test_long_chain_is_closed_whole(spark):
    rows = [(str(i), "B" if i == 0 else "c", i > 0, str(i - 1) if i else "", "", "t") for i in range(30)]
    rows += [(str(100 + i), "c", True, str(99 + i) if i else "29", "", "t") for i in range(5)]
    kids = {str(i): str(i + 1) for i in range(29)}      # 29 does not list 100: an inconsistent edge
    rows = [(*r[:4], kids.get(r[0], ""), r[5]) for r in rows]
    df = spark.createDataFrame(rows, TWEET)
    assert not TH.edges_consistent(df)
    got = {r.tweet_id for r in TH.thread_closure(df, "B").collect()}
    assert got == {str(i) for i in range(30)}       # nothing lists 100, so the walk never comes to it


def test_empty_lines_do_not_depend_on_the_hour(spark):
    for hours in ((1, 2, 3), (1, 1, 1)):
        rows = [(7, i, False, True, f"2017-01-01 0{h}:00:0{i}", x) for i, (h, x) in enumerate(zip(hours, ("a", "", "b")))]
        rows += [(7, 5000, True, False, None, "later"), (7, 40, False, True, None, "late")]
        df = spark.createDataFrame(rows, "conversation_id long, tweet_id long, is_brand boolean, inbound boolean, ts string, text string")
        r = TH.assemble_conversations(df.withColumn("created_at", F.col("ts").cast("timestamp_ntz"))).first()
        assert r.customer_problem == "a\n\nb\nlate"
        assert r.conversation == "Customer: a\nCustomer: \nCustomer: b\nCustomer: late\nBrand: later"


def test_case_ids_of_string_keys_and_null_ids(spark):
    df = spark.createDataFrame([("12", "p"), ("1234567", "p"), ("root-x", "p"), (None, None)], "conversation_id string, customer_problem string")
    df = df.withColumns({"conversation": F.lit("c"), "brand_responses": F.lit("r"), "turn_count": F.lit(2), "intent": F.lit("complaint")})
    assert [r.case_id for r in K.build_cases(df).collect()] == ["C000012", "C1234567", "Croot-x", None]
    num = df.limit(1).withColumn("conversation_id", F.lit(None).cast("long"))
    assert K.index_metadata(K.build_cases(num)).first().conversation_id == ""


def test_numbers_as_text_are_numbers(spark):
    rows = ['{"intent": "complaint", "confidence": "0.7"}', '{"intent": "complaint", "confidence": 0.7}', '{"intent": "x"}',
            '{"confidence": "high"}', '{"confidence": 7}']
    df = spark.createDataFrame([(r,) for r in rows], "j string").withColumn("p", F.from_json("j", I.CLASSIFICATION_SCHEMA))
    got = df.select(I.coerce_classification(F.col("p")).alias("c")).select("c.*").collect()
    assert [(r.intent, r.confidence, r.error) for r in got] == [
        ("complaint", 0.7, None), ("complaint", 0.7, None), ("general_inquiry", 0.3, None),
        ("general_inquiry", 0.3, "confidence is not a number"), ("general_inquiry", 7.0, "confidence out of range")]
    df = spark.createDataFrame([('{"action": "escalate", "risk_score": "0.55", "confidence": "1"}',)], "j string")
    r = df.select(I.coerce_routing(F.from_json("j", I.ROUTING_SCHEMA)).alias("c")).select("c.*").first()
    assert (r.action, r.risk_score, r.confidence, r.has_evidence) == ("escalate", 0.55, 1.0, False)
    df = spark.createDataFrame([('{"response": "hi", "escalate": true}',), ("{}",)], "j string")
    got = df.select(I.coerce_generation(F.from_json("j", I.GENERATION_SCHEMA)).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("hi", [], True, ""), ("", [], False, "")]


def test_masks_read_unicode(spark):
    df = spark.createDataFrame([("é12345",), ("12345é",), ("é 12345 é",), ("١٢٣٤٥",), ("https://t.co/añb c",)], "t string")
    assert [r[0] for r in df.select(pii.mask_text("t")).collect()] == ["é12345", "12345é", "é [ZIP] é", "[ZIP]", "[URL] c"]
    assert df.select(pii.mask_one("t", "ZIP_CODE")).collect()[2][0] == "é [ZIP] é"


def test_provider_of_escalated_rows(spark):
    cls = spark.createDataFrame([("m1", "you charged me twice", "payment_issue", 0.2, "", True),
                                 ("m2", "where is it", "late_delivery", 0.9, "", True)],
                                "message_id string, message string, intent string, confidence double, reasoning string, skip_retrieval boolean")
    ev = spark.createDataFrame([("m2", 2, 0.9, [])], "message_id string, n_cases long, avg_score double, cases array<struct<case_id:string>>")
    got = {r.message_id: (r.escalate, r.used_llm) for r in P.triage(cls, ev).collect()}
    assert got == {"m1": (True, "keyword"), "m2": (False, "template")}


@pytest.mark.parametrize("part", [None, "label"])
def test_scan_and_blocks_give_the_same_top_k(spark, part):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-3, 4, 8).astype(float).tolist(), int(i % 3)) for i in range(150)]       # many ties
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(4)
    a, b = ([tuple(x) for x in V.block_topk(df, df, 5, part=part, exclude_self=True, scan_bytes=s, block_rows=40, chunk_rows=32)
             .orderBy("query_id", "rank").collect()] for s in (0, 64 << 20))
    assert a == b and len(a) == 150 * 5


def test_no_rows_without_a_common_term(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i < 3 else f"word{i} other{i}") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "nothing shared")], "query_id long, text string")
    got = tfidf_retrieve(q, "query_id", "text", docs, "doc_id", "text", top_k=5).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(1, 0), (1, 1), (1, 2)]


def test_classifier_probabilities_and_round_trip(spark, tmp_path):
    rows = [(i, "refund money please refund" if i % 2 else "parcel late again parcel", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y string")
    model = MD.fit_logreg(df, "text", "y", max_iter=20)
    got = MD.predict_labels(model, df, "y").select("y", "pred", "probabilities").collect()
    assert all(r.y == r.pred and abs(sum(r.probabilities.values()) - 1) < 1e-9 and max(r.probabilities, key=r.probabilities.get) == r.pred for r in got)
    MD.save_model(model, str(tmp_path / "m"))
    again = MD.predict_labels(MD.load_model(str(tmp_path / "m")), df, "y").select("pred").collect()
    assert [r.pred for r in again] == [r.pred for r in got]
    # every term is in half of 40 documents: idf = ln(41 / 21) + 1
    scale = next(s for s in model.stages if s.hasParam("scalingVec")).getScalingVec().toArray()
    assert np.allclose(scale, np.log(41 / 21) + 1)


def test_classifier_reads_the_texts_twice_and_shuffles_no_class(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(i, "refund money please refund" if i % 2 else "parcel late again parcel", "a" if i % 3 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y string").mapInPandas(counted, "id long, text string, y string")
    MD.fit_logreg(df, "text", "y", max_iter=5)
    assert seen.value == 3 * 40         # their number, the vocabulary, the counts of its terms
    plan = MD.balanced_weights(spark.createDataFrame(rows, "id long, text string, y string"), "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
