"""Knowledge base of resolution cases (actions, quality, case rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.text import col, contains_any, strip_ws

MENTION = r"@[\p{L}\p{N}_]+"


def _action_of(line: Column) -> Column:
    low = F.lower(line)
    out = None
    for kws, text in L.ACTION_CLASSES:
        cond = contains_any(low, kws)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.when(F.length(line) > L.GUIDANCE_MIN_CHARS, F.lit(L.GUIDANCE_ACTION))


def extract_actions(responses: str | Column) -> Column:
    """Brand actions: per line (mentions removed, stripped, >= 5 chars) the
    first matching action class, else guidance for lines over 20 chars;
    order-preserving de-duplication; joined by a space; none -> default."""
    lines = F.split(strip_ws(F.coalesce(col(responses), F.lit(""))), "\n")
    cleaned = F.transform(F.filter(F.transform(lines, lambda x: strip_ws(x)), lambda x: x != ""),
                          lambda x: strip_ws(F.regexp_replace(x, MENTION, "")))
    kept = F.filter(cleaned, lambda x: F.length(x) >= L.ACTION_MIN_CHARS)
    acts = F.array_distinct(F.filter(F.transform(kept, _action_of), lambda a: a.isNotNull()))
    return F.when(F.size(acts) > 0, F.array_join(acts, " ")).otherwise(F.lit(L.NO_ACTION_TEXT))


def quality_score(responses: str | Column, turn_count: str | Column) -> Column:
    r = col(responses)
    low = F.lower(r)
    s = F.lit(0.0)
    for kws, pts in L.QUALITY_RULES:
        s = s + F.when(contains_any(low, kws), F.lit(pts)).otherwise(F.lit(0.0))
    n = F.length(r)
    s = s + (F.when(n > L.QUALITY_LONG_CHARS, F.lit(L.QUALITY_LONG_POINTS))
             .when(n > L.QUALITY_MID_CHARS, F.lit(L.QUALITY_MID_POINTS)).otherwise(F.lit(0.0)))
    s = F.when(r.isNull(), F.lit(0.0)).otherwise(s)
    return s + F.when(col(turn_count) >= L.QUALITY_TURNS, F.lit(L.QUALITY_TURN_POINTS)).otherwise(F.lit(0.0))


def quality_level(score: Column) -> Column:
    return (F.when(score >= L.QUALITY_STRONG, F.lit("strong"))
            .when(score >= L.QUALITY_MEDIUM, F.lit("medium")).otherwise(F.lit("weak")))


def case_id(key: str | Column) -> Column:
    """Stable case id from the conversation key (not from row position): `C`
    and the key, zero-padded to six characters; keys of any simple type."""
    k = col(key).cast("string")
    return F.concat(F.lit("C"), F.when(F.length(k) >= 6, k).otherwise(F.lpad(k, 6, "0")))


def build_cases(labelled: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Case rows from filtered, labelled conversations."""
    score = quality_score("brand_responses", F.coalesce(F.col("turn_count"), F.lit(2)))
    return labelled.select(
        case_id(key).alias("case_id"),
        F.col(key).alias("conversation_id"),
        F.coalesce("customer_problem", F.lit("")).alias("customer_problem"),
        F.coalesce("conversation", F.lit("")).alias("conversation"),
        F.col("brand_responses"),
        extract_actions("brand_responses").alias("resolution"),
        F.coalesce("intent", F.lit(L.DEFAULT_INTENT)).alias("intent"),
        quality_level(score).alias("resolution_quality"),
        F.coalesce("turn_count", F.lit(2)).alias("turn_count"))


def document_text(problem: str | Column = "customer_problem", resolution: str | Column = "resolution") -> Column:
    return F.concat(F.lit("Customer problem: "), F.coalesce(col(problem), F.lit("")),
                    F.lit("\nHistorical resolution: "), F.coalesce(col(resolution), F.lit("")))


def index_metadata(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.coalesce(F.col("conversation_id").cast("string"), F.lit("")).alias("conversation_id"),
                        F.coalesce("intent", F.lit(L.DEFAULT_INTENT)).alias("intent"),
                        F.coalesce("resolution_quality", F.lit("weak")).alias("resolution_quality"),
                        F.coalesce("turn_count", F.lit(2)).alias("turn_count"))
