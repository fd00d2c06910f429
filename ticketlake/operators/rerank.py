"""Intent-aware rerank of retrieved cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.text import col


def intent_group(c: str | Column, groups=L.INTENT_GROUPS) -> Column:
    out = None
    for gid, members in enumerate(groups):
        cond = col(c).isin(*members)
        out = F.when(cond, F.lit(gid)) if out is None else out.when(cond, F.lit(gid))
    return out


def intent_score(query_intent: str | Column, case_intent: str | Column, groups=L.INTENT_GROUPS) -> Column:
    """1.0 equal, 0.5 same group, else 0 (ungrouped intents never match)."""
    q, c = col(query_intent), col(case_intent)
    return (F.when(q == c, F.lit(1.0))
            .when(intent_group(q, groups) == intent_group(c, groups), F.lit(0.5))
            .otherwise(F.lit(0.0)))


def quality_score(q: str | Column, table=L.QUALITY_SCORES, default: float = L.QUALITY_SCORE_DEFAULT) -> Column:
    out = None
    for name, v in table.items():
        cond = col(q) == name
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


def rerank(retrieved: DataFrame, query_key: str = "query_id", query_intent: str = "query_intent",
           top_k: int = 5, weights=L.RERANK_WEIGHTS) -> DataFrame:
    """Input: one row per (query, retrieved case) with `similarity_score`,
    `retrieval_rank`, case `intent`, `resolution_quality`. Adds the score
    parts and keeps the top_k per query by rerank_score; equal scores keep
    retrieval order (a stable sort)."""
    ws, wi, wq = weights
    sem = F.coalesce(F.col("similarity_score"), F.lit(0.0))
    isc = intent_score(query_intent, F.coalesce(F.col("intent"), F.lit("")))
    qsc = quality_score(F.coalesce(F.col("resolution_quality"), F.lit("weak")))
    scored = retrieved.withColumns({
        "semantic_score": sem, "intent_score": isc, "quality_score": qsc,
        "rerank_score": F.lit(ws) * sem + F.lit(wi) * isc + F.lit(wq) * qsc})
    w = Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), F.asc("retrieval_rank"))
    return scored.withColumn("rerank_rank", F.row_number().over(w)).filter(F.col("rerank_rank") <= top_k)
