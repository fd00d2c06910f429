"""Shared lazy plans: tweets -> threads -> conversations -> processed ->
labelled -> cases, and the message triage plan (classify, gate, retrieve,
rerank, route, reply). Every function returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators import intent as I
from ticketlake.operators import kb as K
from ticketlake.operators import quality as Q
from ticketlake.operators import reply as R
from ticketlake.operators import rerank as RR
from ticketlake.operators import routing as RT
from ticketlake.operators import threads as TH
from ticketlake.operators.postings import Index, build_index, search
from ticketlake.session import cut_lineage
from ticketlake.sources import tables as S

BRAND = "Brand1"
RETRIEVE_K = 10
RERANK_K = 5


# ------------------------------------------------------------------ tweets

def tweets(spark: SparkSession, d: str) -> DataFrame:
    return TH.normalise_tweets(S.raw_tweets(spark, d))


def closure(spark: SparkSession, d: str, brand: str = BRAND) -> DataFrame:
    return TH.thread_closure(tweets(spark, d), brand)


def rooted(spark: SparkSession, d: str, brand: str = BRAND) -> DataFrame:
    """Closure tweets with their thread root."""
    return TH.thread_closure(tweets(spark, d), brand, with_roots=True)


def thread_conversations(spark: SparkSession, d: str, brand: str = BRAND) -> DataFrame:
    return brand_conversations(rooted(spark, d, brand), brand)


def brand_conversations(r: DataFrame, brand: str) -> DataFrame:
    """Conversations of the rooted threads that the brand and others wrote in."""
    two = TH.two_sided_roots(r, brand)
    t = r.join(two.select("root_id"), "root_id", "left_semi").select(
        F.col("root_id").alias("conversation_id"), F.col("tweet_id").cast("long").alias("tweet_id"),
        (F.col("author_id") == brand).alias("is_brand"), "inbound", "created_at", "text")
    return TH.assemble_conversations(t)


# ------------------------------------------------------------------ conversations

def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversation rows over every conversation (assistant = brand)."""
    return TH.assemble_conversations(S.turns(spark, d))


def clean(spark: SparkSession, d: str) -> DataFrame:
    return TH.clean_conversations(conversations(spark, d))


def processed(spark: SparkSession, d: str) -> DataFrame:
    """Masked conversations with a quality reason per row."""
    return Q.processed_conversations(clean(spark, d))


def label_valid(proc: DataFrame) -> DataFrame:
    return I.label_table(proc.filter("is_valid").drop("reason", "is_valid"), "customer_problem", "intent")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return label_valid(processed(spark, d))


def thread_cases(spark: SparkSession, d: str, brand: str = BRAND) -> DataFrame:
    """Tweets -> threads -> conversations -> masked and filtered -> cases."""
    conv = TH.clean_conversations(thread_conversations(spark, d, brand))
    return K.build_cases(label_valid(Q.processed_conversations(conv)))


def cases(spark: SparkSession, d: str) -> DataFrame:
    return K.build_cases(labelled(spark, d))


def kb_table(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base as a written table (reliable checkpoint in the
    shared folder): readers that scan it several times do not rebuild it."""
    return cut_lineage(cases(spark, d))


# ------------------------------------------------------------------ triage

def triage_messages(spark: SparkSession, d: str) -> DataFrame:
    """New-message table: every case's customer problem is a message; its
    taxonomy label (mapped into the closed vocabulary) is the truth."""
    c = kb_table(spark, d)
    return c.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message"),
                    I.map_labels("intent").alias("truth"))


def classified(msgs: DataFrame) -> DataFrame:
    out = I.classify_table(msgs, "message")
    return out.withColumn("skip_retrieval", RT.retrieval_gate("message", "intent", "confidence"))


def kb_index(kb: DataFrame, inverted: bool = False) -> Index:
    return build_index(kb, "case_id", "customer_problem", inverted=inverted)


def retrieved(msgs: DataFrame, kb: DataFrame, k: int = RETRIEVE_K, index: Index | None = None) -> DataFrame:
    """Top-k cases per non-gated message by TF-IDF cosine (self excluded),
    with the case fields joined by key."""
    q = msgs.filter(~F.col("skip_retrieval")).select("message_id", "message")
    hits = search(index or kb_index(kb), q, "message_id", "message", top_k=k,
                  exclude_self=True, q_name="message_id", c_name="case_id")
    fields = kb.select("case_id", I.map_labels("intent").alias("intent"), "resolution_quality",
                       "customer_problem", "resolution", "turn_count")
    return (hits.withColumnRenamed("rank", "retrieval_rank").withColumnRenamed("score", "similarity_score")
                .join(fields, "case_id"))


def reranked(cls: DataFrame, ret: DataFrame, query_intent: str = "intent", k: int = RERANK_K) -> DataFrame:
    q = cls.select("message_id", F.col(query_intent).alias("query_intent"))
    return RR.rerank(ret.join(q, "message_id"), "message_id", "query_intent", top_k=k)


def evidence(rr: DataFrame) -> DataFrame:
    """Per message: number of cases, mean rerank score, ordered case array."""
    case = F.struct("rerank_rank", "case_id", "resolution_quality", "rerank_score", "similarity_score",
                    "customer_problem", "resolution")
    return rr.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("rerank_score").alias("avg_score"),
        F.array_sort(F.collect_list(case)).alias("cases"))


def triage(cls: DataFrame, ev: DataFrame, classifier: str = "keyword") -> DataFrame:
    """Route every message and assemble the reply or escalation. `used_llm`
    names the provider of the last step: the reply's, or, where a message is
    escalated and none is written, the classifier's."""
    j = cls.join(ev, "message_id", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
    r = RT.route("intent", "confidence", "n_cases", "avg_score", "message")
    j = j.withColumn("routing", r)
    ids = F.transform(F.coalesce("cases", F.array()), lambda c: c["case_id"])
    tpl = R.template_reply("intent", ids)
    esc = F.col("routing.action") == "escalate"
    return j.select(
        "message_id", "message", "intent", "confidence", "reasoning", "skip_retrieval", "n_cases",
        "avg_score", "cases",
        F.col("routing.action").alias("action"), F.col("routing.risk_score").alias("risk_score"),
        F.col("routing.reason").alias("routing_reason"), F.col("routing.has_evidence").alias("has_evidence"),
        F.when(esc, R.escalation_message(F.col("routing.reason"), "intent", "confidence"))
         .otherwise(tpl["response"]).alias("response"),
        F.when(esc, F.array().cast("array<string>")).otherwise(tpl["evidence_case_ids"]).alias("evidence_case_ids"),
        esc.alias("escalate"),
        F.when(esc, F.lit("Escalated to human agent")).otherwise(tpl["reason"]).alias("generation_reason"),
        F.when(esc, F.lit(classifier)).otherwise(F.lit("template")).alias("used_llm"))


def triage_all(spark: SparkSession, d: str, kb: DataFrame | None = None, index=None) -> DataFrame:
    """Triage of every message; `kb` and `index` are a written knowledge base
    and its index (`jobs.build_kb`, `jobs.load_index`), else both are built."""
    # the KB is read several times (corpus, vectors, case fields, messages):
    # materialise it once in the shared checkpoint folder
    kb = kb_table(spark, d) if kb is None else kb
    msgs = kb.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message"),
                     I.map_labels("intent").alias("truth"))
    cls = classified(msgs)
    rr = reranked(cls, retrieved(cls, kb, index=index))
    return triage(cls, evidence(rr))


def record(t: DataFrame) -> DataFrame:
    """Result record columns (confidence and risk rounded to 4) plus the
    same record as a JSON string."""
    rec = F.struct(F.col("message").alias("customer_message"), "intent",
                   F.round("confidence", 4).alias("confidence"), F.col("reasoning").alias("classification_reasoning"),
                   "action", F.round("risk_score", 4).alias("risk_score"), "routing_reason", "escalate",
                   "response", "evidence_case_ids", "used_llm")
    return t.select("message_id", rec.alias("r")).select("message_id", "r.*", F.to_json("r").alias("json"))
