"""DuckDB SQL fragments for the correctness oracle, generated from the same
lexicons and parameters as the Spark operators."""

from __future__ import annotations

from collections.abc import Sequence

from ticketlake import lexicons as L
from ticketlake.operators.kb import MENTION
from ticketlake.operators.threads import ID_PATTERN
from ticketlake.operators.tfidf import TOKEN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def lower_text(e: str) -> str:
    return f"lower(coalesce({e}, ''))"


def contains_any(e: str, kws: Sequence[str]) -> str:
    if not kws:
        return "FALSE"
    return "(" + " OR ".join(f"contains({e}, {lit(k)})" for k in kws) + ")"


def count_hits(e: str, kws: Sequence[str]) -> str:
    if not kws:
        return "0"
    return "(" + " + ".join(f"CAST(contains({e}, {lit(k)}) AS INTEGER)" for k in kws) + ")"


def score_cols(e: str, lexicon: dict, prefix: str) -> str:
    """`s0 AS prefix0, ...` keyword score columns."""
    return ", ".join(f"{count_hits(e, kws)} AS {prefix}{i}" for i, kws in enumerate(lexicon.values()))


def best_of(lexicon: dict, prefix: str) -> str:
    cols = [f"{prefix}{i}" for i in range(len(lexicon))]
    return f"greatest({', '.join(cols)})" if len(cols) > 1 else cols[0]


def label_case(lexicon: dict, prefix: str, default: str = L.DEFAULT_INTENT) -> str:
    best = best_of(lexicon, prefix)
    whens = " ".join(f"WHEN {prefix}{i} = {best} AND {best} > 0 THEN {lit(k)}" for i, k in enumerate(lexicon))
    return f"CASE {whens} ELSE {lit(default)} END"


def case_map(e: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {e} = {lit(k)} THEN {v}" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


def str_map(e: str, table: dict, default_sql: str) -> str:
    return case_map(e, {k: lit(v) for k, v in table.items()}, default_sql)


def num_map(e: str, table: dict, default: float) -> str:
    return case_map(e, {k: dbl(v) for k, v in table.items()}, dbl(default))


def in_list(e: str, items: Sequence[str]) -> str:
    return f"{e} IN ({', '.join(lit(i) for i in items)})"


def map_labels(e: str) -> str:
    out = e
    for s, d in L.LABEL_MAP.items():
        out = f"(CASE WHEN {out} = {lit(s)} THEN {lit(d)} ELSE {out} END)"
    return out


def mask(e: str, order=L.PII_PATTERNS) -> str:
    out = e
    for _, p, r in order:
        out = f"regexp_replace({out}, {lit(p)}, {lit(r)}, 'g')"
    return out


def norm_id(e: str) -> str:
    return f"coalesce(regexp_extract(trim({e}), {lit(ID_PATTERN)}, 1), '')"


def child_list(e: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({e}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def ts_str(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


def word_count(e: str) -> str:
    s = strip(e)
    return rf"(CASE WHEN {e} IS NULL THEN NULL WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\s+')) END)"


def action_of(x: str) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN {contains_any(low, kws)} THEN {lit(t)}" for kws, t in L.ACTION_CLASSES)
    return f"CASE {whens} WHEN length({x}) > {L.GUIDANCE_MIN_CHARS} THEN {lit(L.GUIDANCE_ACTION)} ELSE NULL END"


def extract_actions(e: str) -> str:
    lines = f"string_split({strip(f'coalesce({e}, {chr(39)}{chr(39)})')}, chr(10))"
    cleaned = (f"list_transform(list_filter(list_transform({lines}, lambda x: {strip('x')}), lambda x: x <> ''), "
               f"lambda x: {strip(f'regexp_replace(x, {lit(MENTION)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')})")
    kept = f"list_filter({cleaned}, lambda x: length(x) >= {L.ACTION_MIN_CHARS})"
    acts = f"list_filter(list_transform({kept}, lambda x: {action_of('x')}), lambda a: a IS NOT NULL)"
    dedup = f"list_filter({acts}, lambda a, i: NOT list_contains({acts}[1:i-1], a))"
    return f"(CASE WHEN len({dedup}) > 0 THEN array_to_string({dedup}, ' ') ELSE {lit(L.NO_ACTION_TEXT)} END)"


def quality_score(r: str, tc: str) -> str:
    low = f"lower({r})"
    parts = " + ".join(f"(CASE WHEN {contains_any(low, kws)} THEN {dbl(p)} ELSE 0.0::DOUBLE END)" for kws, p in L.QUALITY_RULES)
    ln = (f"(CASE WHEN length({r}) > {L.QUALITY_LONG_CHARS} THEN {dbl(L.QUALITY_LONG_POINTS)} "
          f"WHEN length({r}) > {L.QUALITY_MID_CHARS} THEN {dbl(L.QUALITY_MID_POINTS)} ELSE 0.0::DOUBLE END)")
    return (f"((CASE WHEN {r} IS NULL THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + {parts} + {ln} END) + "
            f"(CASE WHEN {tc} >= {L.QUALITY_TURNS} THEN {dbl(L.QUALITY_TURN_POINTS)} ELSE 0.0::DOUBLE END))")


def quality_level(s: str) -> str:
    return (f"(CASE WHEN {s} >= {dbl(L.QUALITY_STRONG)} THEN 'strong' "
            f"WHEN {s} >= {dbl(L.QUALITY_MEDIUM)} THEN 'medium' ELSE 'weak' END)")


def quality_reason(p="customer_problem", r="brand_responses", c="conversation", tc="turn_count") -> str:
    return (f"CASE WHEN {tc} IS NULL OR {tc} < {L.MIN_TURN_COUNT} THEN 'insufficient_turns' "
            f"WHEN {tc} > {L.MAX_TURN_COUNT} THEN 'too_many_turns' "
            f"WHEN {p} IS NULL OR length({strip(p)}) < {L.MIN_PROBLEM_LENGTH} THEN 'no_customer_problem' "
            f"WHEN {contains_any(lower_text(p), L.SPAM_KEYWORDS)} THEN 'spam' "
            f"WHEN {contains_any(strip(lower_text(p)), L.COMPLIMENT_KEYWORDS)} THEN 'pure_compliment' "
            f"WHEN NOT {contains_any(lower_text(c), L.SUPPORT_KEYWORDS)} THEN 'no_support_interaction' "
            f"WHEN {r} IS NULL OR length({strip(r)}) < {L.MIN_RESPONSE_LENGTH} THEN 'no_amazon_response' "
            f"ELSE 'valid' END")


def classify_cols(e: str, prefix: str = "k") -> tuple[str, str]:
    """(score columns, final columns intent/confidence/reasoning) for the
    confidence classifier; the final columns read the score columns."""
    lex = L.CLASSIFIER_KEYWORDS
    scores = score_cols(lower_text(e), lex, prefix)
    best = best_of(lex, prefix)
    label = label_case(lex, prefix)
    blank = f"({e} IS NULL OR {strip(e)} = '')"
    conf = f"least({dbl(L.CONF_CAP)}, {dbl(L.CONF_BASE)} + CAST({best} AS DOUBLE) * {dbl(L.CONF_STEP)})"
    final = (f"CASE WHEN {blank} THEN {lit(L.DEFAULT_INTENT)} WHEN {best} > 0 THEN {label} ELSE {lit(L.DEFAULT_INTENT)} END AS intent, "
             f"CASE WHEN {blank} THEN {dbl(L.CONF_NONE)} WHEN {best} > 0 THEN {conf} ELSE {dbl(L.CONF_NONE)} END AS confidence, "
             f"CASE WHEN {blank} THEN 'Empty or invalid message' WHEN {best} > 0 THEN 'Keyword match' ELSE 'No keyword match' END AS reasoning")
    return scores, final


def gate(m: str, intent: str, conf: str) -> str:
    s = strip(lower_text(m))
    greet = f"regexp_replace({s}, '[!?.]+$', '') IN ({', '.join(lit(g) for g in L.GREETINGS)})"
    nw = rf"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\s+')) END)"
    trivial = (f"({in_list(intent, L.SKIP_RETRIEVAL_INTENTS)} AND {conf} >= {dbl(L.GATE_MIN_CONFIDENCE)} "
               f"AND {nw} <= {L.GATE_MAX_WORDS})")
    return f"({greet} OR {trivial})"


def risk_expr(intent: str, conf: str, n_cases: str, avg: str) -> str:
    wi, wc, wr, wa = L.RISK_WEIGHTS
    ir = num_map(intent, L.INTENT_RISK, L.INTENT_RISK_DEFAULT)
    rr = (f"(CASE WHEN coalesce({n_cases}, 0) = 0 THEN {dbl(L.NO_CASE_RETRIEVAL_RISK)} "
          f"ELSE 1.0::DOUBLE - least({avg}, 1.0::DOUBLE) END)")
    return (f"least({dbl(wi)} * {ir} + {dbl(wc)} * (1.0::DOUBLE - {conf}) + {dbl(wr)} * {rr} + {dbl(wa)} * 0.0::DOUBLE, "
            f"1.0::DOUBLE)")


def tokens(e: str, stop: Sequence[str] | None = None) -> str:
    t = f"regexp_extract_all(lower({e}), {lit(TOKEN)})"
    if stop:
        t = f"list_filter({t}, lambda x: NOT list_contains([{', '.join(lit(s) for s in stop)}], x))"
    return t


def with_bigrams(t: str) -> str:
    return (f"(CASE WHEN len({t}) >= 2 THEN list_concat({t}, list_transform(range(1, len({t})), "
            f"lambda i: {t}[i] || ' ' || {t}[i + 1])) ELSE {t} END)")
