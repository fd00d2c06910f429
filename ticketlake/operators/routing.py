"""Risk score, routing decision with reasons, and the retrieval gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.text import col, contains_any, lower_text, strip_ws


def lookup(c: str | Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        cond = col(c) == k
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


def risk_score(intent: str | Column, confidence: str | Column, n_cases: str | Column, avg_score: str | Column,
               risk_table=L.INTENT_RISK, weights=L.RISK_WEIGHTS, account_risk: float = 0.0) -> Column:
    """min(1, w_i*intent_risk + w_c*(1-confidence) + w_r*retrieval_risk + w_a*account);
    retrieval_risk = 0.8 with no cases, else 1 - min(avg score, 1)."""
    wi, wc, wr, wa = weights
    ir = lookup(intent, risk_table, L.INTENT_RISK_DEFAULT)
    rr = F.when(F.coalesce(col(n_cases), F.lit(0)) == 0, F.lit(L.NO_CASE_RETRIEVAL_RISK)) \
          .otherwise(F.lit(1.0) - F.least(col(avg_score), F.lit(1.0)))
    risk = F.lit(wi) * ir + F.lit(wc) * (F.lit(1.0) - col(confidence)) + F.lit(wr) * rr + F.lit(wa) * F.lit(account_risk)
    return F.least(risk, F.lit(1.0))


def account_specific(message: str | Column, keywords=L.ACCOUNT_KEYWORDS) -> Column:
    return contains_any(lower_text(message), keywords)


def route(intent: str | Column, confidence: str | Column, n_cases: str | Column, avg_score: str | Column,
          message: str | Column, threshold: float = L.ESCALATION_THRESHOLD,
          response_quality: float = 0.5) -> Column:
    """struct(action, risk_score, reason, intent, confidence, has_evidence)."""
    acct = account_specific(message)
    base = risk_score(intent, confidence, n_cases, avg_score)
    risk = F.when(acct, F.least(base + F.lit(L.ACCOUNT_RISK_BUMP), F.lit(1.0))).otherwise(base)
    escalate = risk >= threshold
    has_ev = F.coalesce(col(n_cases), F.lit(0)) > 0
    reasons = F.array_compact(F.array(
        F.when(col(intent).isin(*L.HIGH_RISK_INTENTS), F.concat(F.lit("High-risk intent: "), col(intent))),
        F.when(col(confidence) < L.LOW_CONFIDENCE,
               F.format_string("Low classification confidence: %.2f", col(confidence))),
        F.when(~has_ev, F.lit("No relevant historical evidence found"))
         .when(F.lit(response_quality) < L.POOR_EVIDENCE, F.lit("Poor quality of retrieved evidence")),
        F.when(acct, F.lit("Message contains account-specific information"))))
    fallback = F.format_string("Combined risk score (%.2f) %s threshold", risk,
                               F.when(escalate, F.lit("exceeds")).otherwise(F.lit("below")))
    reason = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(fallback)
    return F.struct(F.when(escalate, F.lit("escalate")).otherwise(F.lit("auto_handle")).alias("action"),
                    risk.alias("risk_score"), reason.alias("reason"), col(intent).alias("intent"),
                    col(confidence).alias("confidence"), has_ev.alias("has_evidence"))


def retrieval_gate(message: str | Column, intent: str | Column, confidence: str | Column) -> Column:
    """True when retrieval is skipped: a greeting (stripped, lower-cased,
    trailing !?. removed), or a general/complaint intent with confidence >=
    0.85 and at most 8 words."""
    m = strip_ws(lower_text(message))
    greeting = F.regexp_replace(m, r"[!?.]+$", "").isin(*L.GREETINGS)
    n_words = F.when(m == "", F.lit(0)).otherwise(F.size(F.split(m, r"\s+")))
    trivial = (col(intent).isin(*L.SKIP_RETRIEVAL_INTENTS) & (col(confidence) >= L.GATE_MIN_CONFIDENCE)
               & (n_words <= L.GATE_MAX_WORDS))
    return greeting | trivial
