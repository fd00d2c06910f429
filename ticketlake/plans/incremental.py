"""The knowledge base kept up to date by deltas of tweets.

A state holds the tweets with their thread roots, the conversations, the cases,
and for retrieval each case's counted terms and the document frequencies. New
tweets change only the threads that they touch:

- a stored thread changes its root only if the root was waiting for a parent
  that has now arrived; those threads are walked again together with the delta;
- a new tweet whose parent is stored elsewhere takes that thread's stored root.

Conversations and cases are rebuilt for changed threads alone, document
frequencies by subtraction and addition; weights follow from them without
reading a text again. A delta writes a new state and leaves the old one.

Defined cases: an id that is stored already is dropped from the delta (its first
delivery counts); repeated ids within a delta have one parent, the greatest, as
in `threads.thread_roots`; cycles within the delta or closed by it follow the
same cycle rule; an empty delta gives an equal state. As in `thread_closure`, the
conversations of inconsistent dumps are those of whole threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators import postings as B
from ticketlake.operators import kb as K
from ticketlake.operators import quality as Q
from ticketlake.operators import threads as TH
from ticketlake.plans import pipeline as P
from ticketlake.session import write_and_read

TABLES = ("tweets", "conversations", "cases", "grams", "counts")


def read_state(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}


def cases_of(conversations: DataFrame) -> DataFrame:
    """Masked and filtered, written, then labelled: one expression for all of
    it would be too long to compile."""
    done = write_and_read(Q.processed_conversations(TH.clean_conversations(conversations)), "processed")
    return K.build_cases(P.label_valid(done))


def _save(df: DataFrame, at: str, name: str) -> DataFrame:
    df.write.parquet(f"{at}/{name}")
    return df.sparkSession.read.parquet(f"{at}/{name}")


def build(tweets: DataFrame, brand: str, at: str) -> dict[str, DataFrame]:
    """A state from all (normalised) tweets."""
    rows = write_and_read(tweets, "dump")
    rooted = _save(rows.join(TH.thread_roots(rows), "tweet_id"), at, "tweets")
    conv = _save(P.brand_conversations(rooted, brand), at, "conversations")
    cases = _save(cases_of(conv), at, "cases")
    grams = _save(B.grams(cases, "case_id", "customer_problem"), at, "grams")
    _save(B.document_frequencies(grams), at, "counts")
    return read_state(rows.sparkSession, at)


def extend_roots(old: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all tweets with roots, the roots of changed threads, old and new) for
    stored tweets with `root_id` and new tweets."""
    fresh = write_and_read(delta.join(old.select("tweet_id"), "tweet_id", "left_anti"), "delta")
    ids = fresh.select(F.col("tweet_id").alias("in_response_to_tweet_id")).distinct()
    waiting = old.where("root_id = tweet_id AND in_response_to_tweet_id <> ''")
    moved = write_and_read(waiting.join(ids, "in_response_to_tweet_id", "left_semi").select("root_id").distinct(), "moved")
    sub = write_and_read(old.join(moved, "root_id", "left_semi").drop("root_id").unionByName(fresh), "touched")
    sub = sub.join(TH.thread_roots(sub), "tweet_id")
    kept = old.join(moved, "root_id", "left_anti")
    # a root whose parent lies in a thread that did not change goes on there
    ends = (sub.where("root_id = tweet_id AND in_response_to_tweet_id <> ''").select("root_id", F.col("in_response_to_tweet_id").alias("p")).distinct()
               .join(kept.select(F.col("tweet_id").alias("p"), F.col("root_id").alias("up")).distinct(), "p").groupBy("root_id").agg(F.max("up").alias("up")))
    sub = write_and_read(sub.join(ends, "root_id", "left").withColumn("root_id", F.coalesce("up", "root_id")).drop("up"), "rerooted")
    changed = write_and_read(moved.unionByName(sub.select("root_id")).distinct(), "changed")
    return kept.unionByName(sub), changed


def extend(spark: SparkSession, old_at: str, delta: DataFrame, brand: str, at: str) -> dict[str, DataFrame]:
    """The state of the stored tweets and a delta, written to `at`."""
    old = read_state(spark, old_at)
    rooted, changed = extend_roots(old["tweets"], delta)
    rooted = _save(rooted, at, "tweets")
    key = changed.select(F.col("root_id").alias("conversation_id"))
    redone = write_and_read(P.brand_conversations(rooted.join(changed, "root_id", "left_semi"), brand), "conversations")
    _save(old["conversations"].join(key, "conversation_id", "left_anti").unionByName(redone), at, "conversations")
    cases = write_and_read(cases_of(redone), "cases")
    gone = old["cases"].join(key, "conversation_id", "left_semi").select(F.col("case_id").alias("id"))
    _save(old["cases"].join(key, "conversation_id", "left_anti").unionByName(cases), at, "cases")
    # rows of terms: those of rebuilt cases go, new ones come behind the last
    lost, stay = (old["grams"].join(gone, "id", how) for how in ("left_semi", "left_anti"))
    last = old["grams"].agg(F.max("rid").alias("m")).first()["m"]
    new = B.grams(cases, "case_id", "customer_problem")
    new = new.withColumn("rid", F.col("rid") + F.lit(-1 if last is None else last) + 1)
    _save(stay.unionByName(new), at, "grams")
    diff = (old["counts"].unionByName(B.document_frequencies(new))
            .unionByName(B.document_frequencies(lost).withColumn("df", -F.col("df"))))
    _save(diff.groupBy("tid").agg(F.sum("df").alias("df")).where("df > 0"), at, "counts")
    return read_state(spark, at)


def index_of(state: dict[str, DataFrame], inverted: bool = True) -> B.Index:
    """The retrieval index of a state, from its counts."""
    return B.from_grams(state["grams"], state["counts"], state["cases"].count(), inverted)
