"""DuckDB oracle SQL for every registered query. Derived tables are shared
CTEs resolved in dependency order; all doubles are rounded to 6 places."""

from __future__ import annotations

from ticketlake import lexicons as L
from ticketlake.plans import pipeline as P
from ticketlake.plans import sqlgen as G
from ticketlake.operators.tfidf import english_stop_words
from ticketlake.sources import tables as S

BRAND = G.lit(P.BRAND)
NL = "chr(10)"


def _hash(key: str, seed: int) -> str:
    """The first fifteen hexadecimal digits of the MD5 of `seed:key`."""
    return f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT)"


def _phrases(lst: list[str]) -> str:
    return "[" + ", ".join(G.lit(p) for p in lst) + "]"


def _assemble(src: str, brand_speaker: str = "Brand") -> str:
    order = "ORDER BY created_at NULLS LAST, tweet_id"
    spk = f"CASE WHEN is_brand THEN {G.lit(brand_speaker)} ELSE 'Customer' END"
    return f"""SELECT conversation_id,
  coalesce(string_agg({spk} || ': ' || text, {NL} {order}) FILTER (WHERE text IS NOT NULL), '') AS conversation,
  coalesce(string_agg(text, {NL} {order}) FILTER (WHERE text IS NOT NULL AND NOT is_brand), '') AS customer_problem,
  coalesce(string_agg(text, {NL} {order}) FILTER (WHERE text IS NOT NULL AND is_brand), '') AS brand_responses,
  count(tweet_id) AS turn_count, count(*) FILTER (WHERE inbound) AS customer_turns,
  min(created_at) AS first_timestamp, max(created_at) AS last_timestamp
FROM {src} GROUP BY conversation_id"""


def _tfidf(p: str, corpus: str, ckey: str, ctext: str, query: str | None, qkey: str, qtext: str, *,
           max_features: int | None = None, min_df: int = 1, max_df: float = 1.0, stop: bool = False, k: int = 5,
           exclude_self: bool = False) -> dict[str, str]:
    sw = list(english_stop_words()) if stop else None
    c = {
        f"{p}_ctok": f"SELECT {ckey} AS id, {G.tokens(ctext, sw)} AS t FROM {corpus}",
        f"{p}_ctf": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({G.with_bigrams('t')}) AS term FROM {p}_ctok) GROUP BY id, term",
        f"{p}_n": f"SELECT CAST(count(*) AS DOUBLE) AS n FROM {corpus}",
        f"{p}_stats": f"SELECT term, count(*) AS df, sum(tf) AS total FROM {p}_ctf GROUP BY term",
        f"{p}_vocab": (f"SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM {p}_stats, {p}_n "
                       f"WHERE df >= {min_df} AND df <= {G.dbl(max_df)} * n"
                       + (f" ORDER BY total DESC, term LIMIT {max_features}" if max_features else "")),
    }
    if query is None:
        return c
    c.update({
        f"{p}_cw": f"SELECT f.id, f.term, f.tf * v.idf AS w FROM {p}_ctf f JOIN {p}_vocab v USING (term)",
        f"{p}_cv": f"SELECT w.id, w.term, w.w / sqrt(sum(w.w * w.w) OVER (PARTITION BY w.id)) AS w FROM {p}_cw w",
        f"{p}_qtok": f"SELECT {qkey} AS id, {G.tokens(qtext)} AS t FROM {query}",
        f"{p}_qtf": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({G.with_bigrams('t')}) AS term FROM {p}_qtok) GROUP BY id, term",
        f"{p}_qw": f"SELECT f.id, f.term, f.tf * v.idf AS w FROM {p}_qtf f JOIN {p}_vocab v USING (term)",
        f"{p}_qv": f"SELECT w.id, w.term, w.w / sqrt(sum(w.w * w.w) OVER (PARTITION BY w.id)) AS w FROM {p}_qw w",
        f"{p}_s": (f"SELECT q.id AS qid, c.id AS cid, round(sum(q.w * c.w), 12) AS score FROM {p}_qv q JOIN {p}_cv c "
                   f"USING (term) {'WHERE q.id <> c.id' if exclude_self else ''} GROUP BY q.id, c.id"),
        f"{p}_top": (f"SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank "
                     f"FROM {p}_s QUALIFY rank <= {k}"),
    })
    return c


def _ctes() -> dict[str, str]:
    score, final = G.classify_cols("message")
    c: dict[str, str] = {}
    c["msg"] = f"""SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN {_phrases(S.USER_PHRASES)}[((conv_id * 7 + turn) % {len(S.USER_PHRASES)}) + 1]
       WHEN role = 'assistant' THEN {_phrases(S.BRAND_PHRASES)}[((conv_id * 5 + turn) % {len(S.BRAND_PHRASES)}) + 1]
       ELSE '' END AS phrase, text AS text0 FROM conversations"""
    c["msgs"] = "SELECT conv_id, turn, role, phrase, phrase || text0 AS text FROM msg"
    c["tg"] = f"""SELECT conv_id * 100 + turn AS tweet_id,
  CASE WHEN role = 'assistant' THEN 'Brand' || CAST(conv_id % {S.N_BRANDS} AS VARCHAR) ELSE CAST(conv_id AS VARCHAR) END AS author_id,
  role <> 'assistant' AS inbound,
  TIMESTAMP '{S.EPOCH_BASE}' + to_seconds(conv_id * 3600 + turn * 60) AS created_at, text,
  CASE WHEN turn = 0 THEN CASE WHEN conv_id % 11 = 0 THEN {S.UNKNOWN_PARENT_BASE} + conv_id END
       WHEN conv_id % 5 = 0 THEN conv_id * 100 ELSE conv_id * 100 + turn - 1 END AS parent_id, conv_id, turn
FROM msgs"""
    c["kids"] = ("SELECT parent_id AS pid, string_agg(CAST(tweet_id AS VARCHAR), ',' ORDER BY tweet_id) AS kids "
                 "FROM tg WHERE parent_id IS NOT NULL GROUP BY parent_id")
    c["raw"] = """SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, author_id, inbound,
  CASE WHEN conv_id % 13 = 12 THEN strftime(created_at, '%d/%m/%Y %H:%M') ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at,
  text, kids AS response_tweet_id,
  CASE WHEN parent_id IS NOT NULL THEN CAST(parent_id AS VARCHAR) || '.0' END AS in_response_to_tweet_id
FROM tg LEFT JOIN kids ON tg.tweet_id = kids.pid"""
    kid_norm = (f"array_to_string(list_filter(list_transform(string_split(coalesce(response_tweet_id, ''), ','), "
                f"lambda y: {G.norm_id('y')}), lambda y: y <> ''), ',')")
    c["tw"] = f"""SELECT {G.norm_id('tweet_id')} AS tweet_id, author_id, inbound,
  try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, text, {kid_norm} AS response_tweet_id,
  {G.norm_id('in_response_to_tweet_id')} AS in_response_to_tweet_id FROM raw"""
    c["nbr"] = f"""SELECT tweet_id AS src, unnest(list_distinct(list_concat(
    CASE WHEN in_response_to_tweet_id <> '' THEN [in_response_to_tweet_id] ELSE [] END, {G.child_list('response_tweet_id')}))) AS nbr
FROM tw"""
    c["seed"] = (f"SELECT tweet_id AS id FROM tw WHERE author_id = {BRAND} UNION "
                 f"SELECT nbr AS id FROM nbr WHERE src IN (SELECT tweet_id FROM tw WHERE author_id = {BRAND})")
    c["reach"] = "SELECT id FROM seed UNION SELECT n.nbr FROM reach r JOIN nbr n ON n.src = r.id"
    c["rel"] = "SELECT * FROM tw WHERE tweet_id IN (SELECT id FROM reach)"
    c["pm"] = ("SELECT r.tweet_id AS node, CASE WHEN p.tweet_id IS NOT NULL THEN r.in_response_to_tweet_id ELSE r.tweet_id END AS ptr "
               "FROM rel r LEFT JOIN rel p ON p.tweet_id = r.in_response_to_tweet_id")
    c["walk"] = ("SELECT node, node AS cur, 0 AS depth FROM pm UNION ALL "
                 "SELECT w.node, pm.ptr, w.depth + 1 FROM walk w JOIN pm ON pm.node = w.cur WHERE pm.ptr <> w.cur")
    c["roots"] = "SELECT node AS tweet_id, arg_max(cur, depth) AS root_id FROM walk GROUP BY node"
    c["rooted"] = "SELECT rel.*, roots.root_id FROM rel JOIN roots USING (tweet_id)"
    c["two"] = (f"SELECT root_id, count(*) AS n_tweets FROM rooted GROUP BY root_id "
                f"HAVING bool_or(author_id = {BRAND}) AND bool_or(author_id <> {BRAND})")
    c["tturns"] = (f"SELECT root_id AS conversation_id, CAST(tweet_id AS BIGINT) AS tweet_id, author_id = {BRAND} AS is_brand, "
                   f"inbound, created_at, text FROM rooted WHERE root_id IN (SELECT root_id FROM two)")
    c["tconv"] = _assemble("tturns")
    c["turns"] = f"""SELECT conv_id AS conversation_id, conv_id * 100 + turn AS tweet_id, role = 'assistant' AS is_brand,
  role <> 'assistant' AS inbound, TIMESTAMP '{S.EPOCH_BASE}' + to_seconds(conv_id * 3600 + turn * 60) AS created_at, text FROM msgs"""
    c["conv"] = _assemble("turns")
    c["clean"] = f"""SELECT * FROM (SELECT conversation_id, conversation, {G.strip("coalesce(customer_problem, '')")} AS customer_problem,
  {G.strip("coalesce(brand_responses, '')")} AS brand_responses, turn_count, customer_turns, first_timestamp, last_timestamp FROM conv)
WHERE customer_problem <> '' AND brand_responses <> '' AND turn_count >= 2"""
    c["masked"] = f"""SELECT conversation_id, {G.mask('conversation')} AS conversation, {G.mask('customer_problem')} AS customer_problem,
  {G.mask('brand_responses')} AS brand_responses, turn_count, customer_turns, first_timestamp, last_timestamp FROM clean"""
    c["proc"] = f"SELECT *, {G.quality_reason()} AS reason FROM masked"
    c["lab0"] = (f"SELECT *, {G.score_cols(G.lower_text('customer_problem'), L.TAXONOMY_KEYWORDS, 't')} "
                 f"FROM proc WHERE reason = 'valid'")
    c["lab"] = (f"SELECT conversation_id, conversation, customer_problem, brand_responses, turn_count, customer_turns, "
                f"CASE WHEN customer_problem IS NULL THEN {G.lit(L.DEFAULT_INTENT)} ELSE {G.label_case(L.TAXONOMY_KEYWORDS, 't')} END AS intent FROM lab0")
    qs = G.quality_score("brand_responses", "coalesce(turn_count, 2)")
    c["cases"] = f"""SELECT printf('C%06d', conversation_id) AS case_id, conversation_id, coalesce(customer_problem, '') AS customer_problem,
  coalesce(conversation, '') AS conversation, brand_responses, {G.extract_actions('brand_responses')} AS resolution,
  coalesce(intent, {G.lit(L.DEFAULT_INTENT)}) AS intent, {G.quality_level(qs)} AS resolution_quality,
  coalesce(turn_count, 2) AS turn_count FROM lab"""
    # the same chain over the conversations of the rebuilt threads, whose keys are strings
    import re
    for n in ("clean", "masked", "proc", "lab0", "lab", "cases"):
        sql = re.sub(r"\bFROM (conv|clean|masked|proc|lab0|lab)\b", lambda m: "FROM " + ("tconv" if m[1] == "conv" else "th_" + m[1]), c[n])
        c["th_" + n] = sql.replace("printf('C%06d', conversation_id)",
                                   "'C' || CASE WHEN length(conversation_id) >= 6 THEN conversation_id ELSE lpad(conversation_id, 6, '0') END")
    # ------------------------------------------------------------- triage
    c["tmsg"] = f"SELECT case_id AS message_id, customer_problem AS message, {G.map_labels('intent')} AS truth FROM cases"
    c["cls0"] = f"SELECT *, {score} FROM tmsg"
    c["cls1"] = f"SELECT message_id, message, truth, {final} FROM cls0"
    c["cls"] = f"SELECT *, {G.gate('message', 'intent', 'confidence')} AS skip_retrieval FROM cls1"
    c["q_in"] = "SELECT message_id, message FROM cls WHERE NOT skip_retrieval"
    c.update(_tfidf("tr", "cases", "case_id", "customer_problem", "q_in", "message_id", "message",
                    k=P.RETRIEVE_K, exclude_self=True))
    c["ret"] = f"""SELECT t.qid AS message_id, t.cid AS case_id, t.rank AS retrieval_rank, t.score AS similarity_score,
  {G.map_labels('k.intent')} AS intent, k.resolution_quality, k.customer_problem, k.resolution, k.turn_count
FROM tr_top t JOIN cases k ON k.case_id = t.cid WHERE t.score >= 0.01"""
    c["rr"] = _rerank_sql("ret", "cls", "intent")
    c["ev"] = ("SELECT message_id, count(*) AS n_cases, avg(rerank_score) AS avg_score, "
               "list(case_id ORDER BY rerank_rank) AS case_ids FROM rr GROUP BY message_id")
    c["tri0"] = ("SELECT c.*, coalesce(e.n_cases, 0) AS n_cases, e.avg_score, coalesce(e.case_ids, []) AS case_ids "
                 "FROM cls c LEFT JOIN ev e USING (message_id)")
    c["tri1"] = f"""SELECT *, {G.contains_any(G.lower_text('message'), L.ACCOUNT_KEYWORDS)} AS acct,
  {G.risk_expr('intent', 'confidence', 'n_cases', 'avg_score')} AS risk0 FROM tri0"""
    c["tri2"] = f"""SELECT *, CASE WHEN acct THEN least(risk0 + {G.dbl(L.ACCOUNT_RISK_BUMP)}, 1.0::DOUBLE) ELSE risk0 END AS risk_score FROM tri1"""
    reasons = (f"list_filter([CASE WHEN {G.in_list('intent', L.HIGH_RISK_INTENTS)} THEN 'High-risk intent: ' || intent END, "
               f"CASE WHEN confidence < {G.dbl(L.LOW_CONFIDENCE)} THEN printf('Low classification confidence: %.2f', confidence) END, "
               f"CASE WHEN n_cases = 0 THEN 'No relevant historical evidence found' END, "
               f"CASE WHEN acct THEN 'Message contains account-specific information' END], lambda x: x IS NOT NULL)")
    c["tri3"] = f"""SELECT *, risk_score >= {G.dbl(L.ESCALATION_THRESHOLD)} AS escalate, {reasons} AS reasons FROM tri2"""
    tpl = G.str_map("intent", L.TEMPLATES, G.lit(L.TEMPLATES[L.DEFAULT_INTENT]))
    c["tri"] = f"""SELECT message_id, message, truth, intent, confidence, reasoning, skip_retrieval, n_cases, avg_score, case_ids,
  CASE WHEN escalate THEN 'escalate' ELSE 'auto_handle' END AS action, risk_score,
  CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ')
       ELSE printf('Combined risk score (%.2f) %s threshold', risk_score, CASE WHEN escalate THEN 'exceeds' ELSE 'below' END) END AS routing_reason,
  n_cases > 0 AS has_evidence, escalate,
  CASE WHEN NOT escalate THEN list_filter(case_ids[1:3], lambda x: x IS NOT NULL AND x <> '') ELSE [] END AS evidence_case_ids,
  CASE WHEN escalate THEN 'Escalated to human agent' ELSE 'Template response for ' || intent END AS generation_reason,
  CASE WHEN escalate THEN 'keyword' ELSE 'template' END AS used_llm, {tpl} AS template FROM tri3"""
    c["tri_out"] = """SELECT *, CASE WHEN escalate THEN printf('This message has been escalated to a human agent.' || chr(10) || 'Reason: %s' || chr(10) || 'Intent: %s (confidence: %.2f)',
  routing_reason, intent, round(confidence, 2)) ELSE template END AS response FROM tri"""
    return c


def _rerank_sql(ret: str, cls: str, qi: str) -> str:
    ws, wi, wq = L.RERANK_WEIGHTS
    grp = lambda e: "CASE " + " ".join(f"WHEN {G.in_list(e, m)} THEN {i}" for i, m in enumerate(L.INTENT_GROUPS)) + " END"
    isc = f"(CASE WHEN q.{qi} = r.intent THEN 1.0::DOUBLE WHEN {grp('q.' + qi)} = {grp('coalesce(r.intent, ' + chr(39) + chr(39) + ')')} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"
    qsc = G.num_map("coalesce(r.resolution_quality, 'weak')", L.QUALITY_SCORES, L.QUALITY_SCORE_DEFAULT)
    inner = f"""SELECT r.*, coalesce(r.similarity_score, 0.0::DOUBLE) AS semantic_score, {isc} AS intent_score, {qsc} AS quality_score
FROM {ret} r JOIN {cls} q USING (message_id)"""
    return f"""SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY rerank_score DESC, retrieval_rank) AS rerank_rank FROM (
  SELECT *, {G.dbl(ws)} * semantic_score + {G.dbl(wi)} * intent_score + {G.dbl(wq)} * quality_score AS rerank_score FROM ({inner}))
QUALIFY rerank_rank <= {P.RERANK_K}"""


_DEPS_CACHE: dict[str, str] | None = None


def ctes() -> dict[str, str]:
    global _DEPS_CACHE
    if _DEPS_CACHE is None:
        _DEPS_CACHE = _ctes()
    return _DEPS_CACHE


def build(select: str, extra: dict[str, str] | None = None) -> str:
    """WITH RECURSIVE <needed ctes> <select>; CTEs are included when their
    name appears (as a word) in the select or in an included CTE."""
    import re
    allc = dict(ctes())
    if extra:
        allc.update(extra)
    names = list(allc)
    need: list[str] = []

    def visit(text: str):
        for n in names:
            if n not in need and re.search(rf"\b{re.escape(n)}\b", text):
                need.append(n)
                visit(allc[n])
    visit(select)
    ordered = [n for n in names if n in need]
    body = ",\n".join(f"{n} AS ({allc[n]})" for n in ordered)
    return f"WITH RECURSIVE {body}\n{select}" if ordered else select
