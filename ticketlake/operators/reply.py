"""Reply assembly: templates, evidence blocks, escalation text, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.text import col

NO_EVIDENCE = "No relevant historical cases found."


def template_for(intent: str | Column, templates=L.TEMPLATES) -> Column:
    out = None
    for k, v in templates.items():
        cond = col(intent) == k
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(templates[L.DEFAULT_INTENT]))


def template_reply(intent: str | Column, case_ids: str | Column) -> Column:
    """struct(response, evidence_case_ids, escalate, reason): first three case
    ids, then empty ids dropped (slice first, as the original does)."""
    ids = F.filter(F.slice(F.coalesce(col(case_ids), F.array().cast("array<string>")), 1, 3),
                   lambda x: (x != "") & x.isNotNull())
    return F.struct(template_for(intent).alias("response"), ids.alias("evidence_case_ids"),
                    col(intent).isin(*L.ESCALATION_INTENTS).alias("escalate"),
                    F.concat(F.lit("Template response for "), col(intent)).alias("reason"))


def evidence_text(cases: str | Column, brand_label: str = "Brand", width: int = 300) -> Column:
    """Numbered-case block per message from ARRAY<STRUCT<case_id,
    resolution_quality, rerank_score, customer_problem, resolution>>; the
    score is rounded to 3 places numerically before formatting."""
    def one(c):
        score = F.round(F.coalesce(c["rerank_score"], F.lit(0.0)), 3)
        return F.format_string(
            "Case %s (Quality: %s, Relevance: %.3f):\n  Customer problem: %s\n  " + brand_label + " resolution: %s",
            c["case_id"], F.coalesce(c["resolution_quality"], F.lit("unknown")), score,
            F.substring(F.coalesce(c["customer_problem"], F.lit("N/A")), 1, width),
            F.substring(F.coalesce(c["resolution"], F.lit("N/A")), 1, width))
    arr = F.coalesce(col(cases), F.array())
    return F.when(F.size(arr) == 0, F.lit(NO_EVIDENCE)).otherwise(F.array_join(F.transform(arr, one), "\n\n"))


def escalation_message(reason: str | Column, intent: str | Column, confidence: str | Column) -> Column:
    return F.format_string("This message has been escalated to a human agent.\nReason: %s\nIntent: %s (confidence: %.2f)",
                           col(reason), col(intent), F.round(col(confidence), 2))


# Prompt table for an external batch scorer. The wording is ours and is a
# parameter; placeholders are named columns.
JUDGE_TEMPLATE = ("Score this support reply from 1 to 5 on groundedness, correctness, helpfulness, safety "
                  "and escalation. Answer with a JSON object of those five keys.\n"
                  "Message: {message}\nIntent: {intent}\nReply: {response}\nEvidence: {evidence}")

CLASSIFY_TEMPLATE = ("Choose exactly one intent for this customer message.\nIntents: {intents}\nMessage: {message}\n"
                     "Answer with a JSON object of intent, confidence (0 to 1) and reasoning.")
GENERATE_TEMPLATE = ("Draft a reply to this customer message that rests only on the evidence; promise nothing it does not hold.\n"
                     "Message: {message}\nIntent: {intent}\nEvidence: {evidence}\n"
                     "Answer with a JSON object of response, evidence_case_ids, escalate and reason.")


def prompt_rows(template: str, **fields: Column) -> Column:
    """Fill `{name}` placeholders from columns (format_string, no UDF)."""
    import re
    names = re.findall(r"{(\w+)}", template)
    fmt = re.sub(r"{\w+}", "%s", template.replace("%", "%%"))
    return F.format_string(fmt, *[F.coalesce(fields[n], F.lit("")) for n in names])
