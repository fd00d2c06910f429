"""Conversation quality: a reject reason per row (first failing rule wins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.pii import mask_columns
from ticketlake.functions.text import col, computed_once, contains_any, lower_text, strip_ws

REASONS = ["insufficient_turns", "too_many_turns", "no_customer_problem", "spam",
           "pure_compliment", "no_support_interaction", "no_amazon_response", "valid"]


def is_spam(c: str | Column, keywords=L.SPAM_KEYWORDS) -> Column:
    return contains_any(lower_text(c), keywords)


def is_compliment(c: str | Column, keywords=L.COMPLIMENT_KEYWORDS) -> Column:
    return contains_any(strip_ws(lower_text(c)), keywords)


def has_support_interaction(c: str | Column, keywords=L.SUPPORT_KEYWORDS) -> Column:
    return contains_any(lower_text(c), keywords)


def quality_reason(problem: str | Column = "customer_problem", responses: str | Column = "brand_responses",
                   conversation: str | Column = "conversation", turn_count: str | Column = "turn_count",
                   min_turns: int = L.MIN_TURN_COUNT, max_turns: int = L.MAX_TURN_COUNT,
                   min_problem: int = L.MIN_PROBLEM_LENGTH, min_response: int = L.MIN_RESPONSE_LENGTH) -> Column:
    tc, p, r = col(turn_count), col(problem), col(responses)
    return (F.when(tc.isNull() | (tc < min_turns), F.lit("insufficient_turns"))
            .when(tc > max_turns, F.lit("too_many_turns"))
            .when(p.isNull() | (F.length(strip_ws(p)) < min_problem), F.lit("no_customer_problem"))
            .when(is_spam(p), F.lit("spam"))
            .when(is_compliment(p), F.lit("pure_compliment"))
            .when(~has_support_interaction(col(conversation)), F.lit("no_support_interaction"))
            .when(r.isNull() | (F.length(strip_ws(r)) < min_response), F.lit("no_amazon_response"))
            .otherwise(F.lit("valid")))


def with_reasons(conv: DataFrame, **kw) -> DataFrame:
    return conv.withColumn("reason", quality_reason(**kw)) \
               .withColumn("is_valid", F.col("reason") == "valid")


def with_share(counts: DataFrame, n: str, out: str) -> DataFrame:
    """Percent of total over an already-aggregated table (one row per label,
    so the single-partition total window is bounded by the label count)."""
    total = F.sum(n).over(Window.partitionBy())
    return counts.withColumn(out, F.round(F.try_divide(F.col(n) * 100.0, total), 6))


def removal_report(reasoned: DataFrame) -> DataFrame:
    """(reason, n, pct): one row per reason incl. 'valid'; pct of all rows."""
    counts = reasoned.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", "pct")


def processed_conversations(conv: DataFrame, columns=("conversation", "customer_problem", "brand_responses"),
                            order: str = "reference") -> DataFrame:
    """Mask PII in the text columns, then attach quality reasons (lengths are
    measured after masking). Masks are computed once a row, whatever filters
    and labels read the masked texts."""
    return with_reasons(computed_once(mask_columns(computed_once(conv), list(columns), order)))
