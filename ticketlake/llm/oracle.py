"""DuckDB SQL for the rows of the registered queries that SQL can express.

The statements state each contract anew: windows as word lists, matches by the
regular expressions themselves, the exponent in closed form, positions by plain
running sums.
"""

from __future__ import annotations

from ticketlake.llm.secrets_trigram import BASE_RULES, RULES
from ticketlake.llm.url_vocabulary import RULES as URL_RULES
from ticketlake.llm.url_vocabulary import SOFT, STRICT

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------- op2, mixing

def mixing_sql(max_repeats: float = 2.0, block_tokens: int = 1_000_000, seed: int = 17) -> str:
    """With the least budget that uses every document, the most repeated source
    is the smallest one: (largest / smallest) ^ (1 - a) = max_repeats."""
    draw = f"md5(concat_ws(':', '{seed}', pass, coalesce(CAST(doc_id AS VARCHAR), ''), n_tokens, tie))"
    order = f"md5(concat_ws(':', '{seed}', 'block', block, pass, coalesce(CAST(doc_id AS VARCHAR), ''), n_tokens, tie))"
    return f"""
WITH t0 AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT *, CASE WHEN count(*) OVER same > 1 THEN row_number() OVER same - 1 END AS tie FROM t0
  WINDOW same AS (PARTITION BY source, doc_id, n_tokens)),
s AS (SELECT source, sum(n_tokens) AS tokens FROM t GROUP BY source),
e AS (SELECT max(tokens) AS m, CASE WHEN max(tokens) = min(tokens) THEN 0.0 ELSE round(greatest(0.0,
        1 - ln({max_repeats!r}) / ln(max(tokens) / min(tokens))), 6) END AS a FROM s WHERE tokens > 0),
w AS (SELECT source, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens > 0
        THEN round(pow(m / tokens, 1 - a), 9) ELSE 1.0 END AS repeats FROM s, e),
b AS (SELECT greatest(1, CAST(ceil(sum(repeats * tokens) / {block_tokens}) AS BIGINT)) AS n_blocks FROM w),
u AS (SELECT t.doc_id, t.source, n_tokens, tie, tokens, repeats,
        unnest(range(0, greatest(1, CAST(ceil(repeats) AS BIGINT)))) AS pass
      FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY {draw}, doc_id, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pass * tokens AS place FROM u),
k AS (SELECT *, least(n_blocks - 1, CAST(floor(n_blocks * CASE WHEN tokens > 0 THEN place / (repeats * tokens)
        ELSE CAST('0x' || substr({draw}, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE END) AS BIGINT)) AS block FROM p, b WHERE pass = 0 AND repeats >= 1 OR place < repeats * tokens)
SELECT doc_id, source, n_tokens, CAST(pass AS INTEGER) AS pass, CAST(block AS BIGINT) AS block,
  row_number() OVER (PARTITION BY block ORDER BY {order}, source, pass, doc_id, n_tokens) AS position
FROM k"""


# ------------------------------------------------------- op3, perspectives

def _clean_sql(c: str) -> str:
    return f"replace(coalesce({c}, ''), '<|', '< |')"


PERSPECTIVES_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif({_clean_sql('role')}, ''), 'unknown') AS speaker,
             {_clean_sql('text')} AS txt FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, txt) - 1 AS place FROM t),
who AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
r AS (SELECT n.conv_id, participant, place // 256 AS part, place, speaker = participant AS mine,
        '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant'
          ELSE 'user name=' || speaker END || chr(10) AS head, txt || '<|im_end|>' AS body
      FROM n JOIN who ON n.conv_id IS NOT DISTINCT FROM who.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY place)
    FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, participant, part"""


# ----------------------------------------------------- op4, substring dedup

REPEATS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
x AS (SELECT r, list(i ORDER BY i) AS hits FROM w JOIN c USING (h) GROUP BY r),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM (SELECT r, unnest(hits) AS i FROM x)),
k AS (SELECT d.r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
      FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) d
      ANTI JOIN g ON g.r = d.r AND g.p = d.p GROUP BY d.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


# ----------------------------------------------------------------- op5, WARC

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are twenty bits, or four base32 digits.
_GROUPS = " || ".join(
    f"'{_B32}'[1 + ((g[{i + 1}] >> {s}) & 31)]" for i in range(8) for s in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT *, sha1(h) AS sha, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes FROM p),
b AS (SELECT *, [CAST('0x' || sha[5 * i + 1:5 * i + 5] AS BIGINT) FOR i IN range(8)] AS g,
        row_number() OVER (PARTITION BY sha, payload_bytes ORDER BY page_id NULLS LAST, coalesce(url, '')) AS k,
        first_value(page_id) OVER (PARTITION BY sha, payload_bytes ORDER BY page_id NULLS LAST, coalesce(url, '')) AS f FROM s)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM b"""


# ------------------------------------------------------------------ op7, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count_terms(terms: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


def url_sql() -> str:
    ranked = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))       # the sort keeps the order of equal lengths
    fits = [f"WHEN host <> '' AND (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)})"
            for h, p, _ in ranked]
    rule = "CASE " + " ".join(f"{w} THEN {q(h + p)}" for w, (h, p, _) in zip(fits, ranked)) + " END"
    verdict = ("CASE " + " ".join(f"{w} THEN {q(v)}" for w, (_, _, v) in zip(fits, ranked))
               + " WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END")
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *, {_count_terms(STRICT)} AS n_strict, {_count_terms(SOFT)} AS n_soft FROM b)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft FROM c"""


# --------------------------------------------------------------- op10, secrets

def secrets_sql() -> str:
    found = []
    for i, r in enumerate(RULES):
        # a run of one class is shorter than the least length or counts whole
        rx = q(f"{r.regex[:-1]}{{{r.min_len},}}" if r.kind == "hex" else r.regex)
        found.append(f"""SELECT r, '{r.kind}' AS kind, {i} AS ord, e - len AS s, e FROM (
  SELECT r, len, glen, sum(gap + len) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest([length(x) FOR x IN gaps[:len(m)]]) AS gap,
      unnest([length(x) FOR x IN m]) AS len, unnest([length(x) FOR x IN g]) AS glen FROM (
      SELECT r, string_split_regex(t, {rx}) AS gaps, regexp_extract_all(t, {rx}) AS m,
        regexp_extract_all(t, {rx}, {r.group}) AS g FROM d WHERE regexp_matches(t, {rx}))))
WHERE glen >= {r.min_len}""")
    base = ", ".join(q(r.kind) for r in BASE_RULES)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(found)}),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  coalesce(string_agg({one}, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({base})), '') AS base,
  string_agg({one}, ',' ORDER BY s, ord) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


# ---------------------------------------------------------- op11, trie codes

def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Plain nearest entries over all parts and entries, floors of the means."""
    dist = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])"
    ctes = [f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
  [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
            f"""p AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM (SELECT r, v, unnest(range({parts})) AS p FROM k))""",
            "d AS MATERIALIZED (SELECT p, x, count(*) AS n FROM p GROUP BY p, x)",
            f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM p WHERE r <= {entries})"]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT d.p, x, any_value(n) AS n, min({dist} * {entries} + e) AS best "
                    f"FROM d JOIN b{i} b ON d.p = b.p GROUP BY d.p, x)")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT p, e, list(CAST(floor_of AS BIGINT) ORDER BY i) AS c FROM (
  SELECT p, e, i, (s - ((s % n) + n) % n) // n AS floor_of FROM (
    SELECT p, best % {entries} AS e, i, sum(x[i] * n) AS s, sum(n) AS n
    FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY ALL)) GROUP BY p, e)""")
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))")
    ctes.append(f"""o AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', best % {entries}), '' ORDER BY p.p) AS code,
  CAST(sum(best // {entries}) AS BIGINT) AS error FROM k JOIN p USING (r) JOIN a{rounds} a ON a.p = p.p AND a.x = p.x
  GROUP BY k.r, k.vec_id, k.label)""")
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM o"""


# ------------------------------------------------------ op13, fill in middle

_DRAWS = ", ".join(f"CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
MIDDLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_DRAWS} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x"""


ORACLE = {
    "op2_temperature_mixing": mixing_sql(),
    "op3_perspectives": PERSPECTIVES_SQL,
    "op4_suffix_repeats": REPEATS_SQL,
    "op5_warc_zstd": WARC_SQL,
    "op7_url_vocabulary": url_sql(),
    "op10_secret_scan": secrets_sql(),
    "op11_trie_codes": codes_sql(),
    "op13_fill_in_middle": MIDDLE_SQL,
}
