"""Deltas against full builds, versions of the store, and the stream's state."""
import random

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import postings as B
from ticketlake.operators import threads as TH
from ticketlake.plans import incremental as INC
from ticketlake.plans import kb_store as KS
from ticketlake.plans import pipeline as P
from ticketlake.streaming.triage import start_triage_stream

SF = "/root/testdata/sf0.001"
TWEET = "tweet_id string, in_response_to_tweet_id string"


@pytest.mark.parametrize("seed", range(3))
def test_roots_of_deltas_equal_a_full_walk(spark, seed):
    """Random reply graphs with cycles, unknown parents and torn threads."""
    r = random.Random(seed)
    n = 120
    parent = {i: ("" if r.random() < 0.15 else str(r.randint(0, n + 5)) if r.random() < 0.4 else str(max(0, i - r.randint(1, 4)))) for i in range(n)}
    rows = [(str(i), p) for i, p in parent.items()]
    r.shuffle(rows)
    cuts = sorted(r.sample(range(n), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    frame = lambda x: spark.createDataFrame(x, TWEET)
    now = frame(parts[0])
    now = now.join(TH.thread_roots(now), "tweet_id")
    for p in parts[1:]:
        now, changed = INC.extend_roots(now, frame(p + parts[0][:2]))         # two ids come again
        now = B.write_and_read(now, "state")
    want = {(x.tweet_id, x.root_id) for x in TH.thread_roots(frame(rows)).collect()}
    assert {(x.tweet_id, x.root_id) for x in now.collect()} == want and now.count() == n


def test_deltas_give_the_tables_of_a_full_build(spark, tmp_path):
    tw = B.write_and_read(P.tweets(spark, SF), "tweets")
    full = INC.build(tw, P.BRAND, str(tmp_path / "full"))
    part = F.pmod(F.xxhash64("tweet_id", F.lit(9)), F.lit(2))
    INC.build(tw.where(part == 0), P.BRAND, str(tmp_path / "0"))
    state = INC.extend(spark, str(tmp_path / "0"), tw.where(part == 1), P.BRAND, str(tmp_path / "1"))
    same = INC.extend(spark, str(tmp_path / "1"), tw.where("false"), P.BRAND, str(tmp_path / "2"))
    for got in (state, same):
        for name in ("tweets", "conversations", "cases", "counts"):
            rows = lambda t: sorted(map(repr, t.select(sorted(full[name].columns)).collect()))  # noqa: E731, B023
            assert rows(got[name]) == rows(full[name]), name
    terms = lambda t: sorted((x.id, tuple(x.tids), tuple(x.tfs)) for x in t["grams"].collect())
    assert terms(state) == terms(full)
    q = full["cases"].select(F.col("case_id").alias("q"), F.col("customer_problem").alias("t"))
    hits = [{(x.q, x.d, x["rank"], round(x.score, 9)) for x in B.search(INC.index_of(s), q, "q", "t", q_name="q", c_name="d").collect()}
            for s in (full, state)]
    assert hits[0] == hits[1] and hits[0]


@pytest.fixture(scope="module")
def cases(spark):
    return B.write_and_read(P.cases(spark, SF), "cases")


def test_versions_are_swapped_whole_and_pruned_by_intent(spark, tmp_path, cases):
    base = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        KS.load(spark, base)
    one = KS.publish(cases, base, rank=4, buckets=128)
    assert KS.load(spark, base).name == one.name and KS.load(spark, base).cases.count() == cases.count()
    two = KS.publish(cases.limit(3), base, rank=4, buckets=128)
    assert KS.current(spark, base) == two.name != one.name
    assert KS.load(spark, base).cases.count() == 3 and one.cases.count() == cases.count()     # readers of the old one go on
    KS.set_current(spark, base, one.name)                                                    # and back
    now = KS.load(spark, base)
    enc = now.encoder
    assert enc.basis.shape == (128, 4) and enc.ngram_max == 2
    some = now.cases.groupBy("intent").count().orderBy(F.desc("count")).first().intent
    plan = now.cases.where(F.col("intent") == some)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(intent" in plan
    spark.createDataFrame([(some, 1), ("other", 2)], "intent string, k int").write.parquet(str(tmp_path / "wanted"))
    joined = now.cases.join(spark.read.parquet(str(tmp_path / "wanted")).where("k = 1"), "intent")
    assert "dynamicpruning" in joined._jdf.queryExecution().toString()
    msgs = cases.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message"), "intent")
    got = KS.similar_cases(now, msgs, k=3, intent="intent", exclude_self=True).collect()
    intent = {x.case_id: x.intent for x in cases.collect()}
    assert got and all(intent[x.message_id] == intent[x.case_id] for x in got)
    everything = KS.similar_cases(now, msgs, k=3).collect()
    assert {x.message_id for x in everything} == set(intent)


def test_a_message_delivered_twice_is_triaged_once_and_versions_take_effect(spark, tmp_path, cases):
    base, run, inbox = (str(tmp_path / x) for x in ("store", "run", "inbox"))
    one = KS.publish(cases, base, dense=False)
    msgs = cases.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message"),
                        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("sent_at")).orderBy("message_id")
    first, second = msgs.limit(4), msgs.limit(6)
    first.coalesce(1).write.mode("append").parquet(inbox)

    def run_once():
        q = start_triage_stream(spark, inbox, msgs.schema, base, run, event_time="sent_at")
        q.awaitTermination()
        return spark.read.parquet(f"{run}/out").select("message_id", "kb_version").collect()

    assert {x.kb_version for x in run_once()} == {one.name}
    two = KS.publish(cases.where("case_id <> 'none'"), base, dense=False)
    second.coalesce(1).write.mode("append").parquet(inbox)          # four of the six come again
    got = run_once()                                                 # the stream goes on from its checkpoint
    ids = [x.message_id for x in got]
    assert sorted(ids) == sorted(x.message_id for x in second.collect())
    assert sum(x.kb_version == two.name for x in got) == 2 and sum(x.kb_version == one.name for x in got) == 4
    assert len(run_once()) == 6                                      # nothing new: nothing lost, nothing doubled
