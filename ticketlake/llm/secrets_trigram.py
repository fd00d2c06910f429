"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is reduced to a Boolean query over trigrams that
any match must hold: an OR of ANDs, derived from the parsed expression. The
index has a posting (trigram, text) for every text and every trigram that some
rule mentions; intersecting the postings of each AND gives a rule's candidates.
A rule without mandatory trigrams scans every text. Candidates are verified
with the rule's expression; their spans are character positions.

Texts are known by their MD5, so copies are indexed and verified once, however
many there are, and rows need no unique id. Matches are positioned by the
lengths of the pieces between them, summed over a window per text and rule
(bounded by one text).

Defined cases: a null text is an empty text without spans; repeated ids and
rows give a row each; very long texts are scanned whole; spans that begin
together are ordered as the rules are; an empty table gives an empty result.
Helper columns take names that the table does not have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import col, fresh, written


@dataclass(frozen=True)
class Rule:
    """`regex` (Java and Python read it alike); a match counts if its group
    `group` has `min_len` characters or more."""
    kind: str
    regex: str
    group: int = 0
    min_len: int = 0


# --------------------------------------------------------------------------
# FIXED VALUES: the base rules (assign, access, hex), then this method's own.
# Letters in either case are spelled out, so that no engine folds other ones.
# --------------------------------------------------------------------------
_KEYWORDS = ("[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
             "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
BASE_RULES = [
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
]
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
]
RULES = BASE_RULES + MORE_RULES


# ------------------------------------------------------------ trigram queries

_MOST = 32          # literal alternatives kept apart while a run is extended


def _strings(node) -> set[str] | None:
    """The finite set of strings (ASCII lower case) a node matches, if small."""
    op, av = node
    if op is rc.LITERAL:
        return {chr(av).lower()}
    if op is rc.IN:
        chars: set[str] = set()
        for o, v in av:
            if o is rc.LITERAL:
                chars.add(chr(v).lower())
            elif o is rc.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is rc.SUBPATTERN:
        return _sequence(av[-1])
    if op is rc.BRANCH:
        parts = [_sequence(x) for x in av[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is rc.MAX_REPEAT and av[1] <= 2 and (one := _sequence(av[2])) is not None:
        return {"".join(x) for k in range(av[0], av[1] + 1) for x in product(one, repeat=k)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        if (s := _strings(node)) is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match holds; empty if
    the expression has no mandatory trigram. Consecutive parts with few
    strings are joined to runs; the most selective run makes the query."""
    best: list[frozenset[str]] = []

    def offer(run: set[str]) -> None:
        nonlocal best
        if all(len(s) >= 3 for s in run):
            ands = {frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in run}
            ands = {a for a in ands if not any(b < a for b in ands)}
            if not best or min(map(len, ands)) > min(map(len, best)):
                best = sorted(ands, key=sorted)

    run = {""}
    for node in rp.parse(regex):
        s = _strings(node)
        if s is not None and len(run) * len(s) <= _MOST:
            run = {a + b for a in run for b in s}
            continue
        offer(run)
        run = s if s is not None else {""}
    offer(run)
    return best


# --------------------------------------------------------------------- index

def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def build_index(docs: DataFrame, text_col: str, rules: list[Rule]) -> DataFrame:
    """(term, key): the inverted index, a posting for every text and every
    trigram of the rules' queries; term `scan:<kind>` lists the texts that a
    rule without mandatory trigrams matches in its full scan."""
    text = F.coalesce(col(text_col), F.lit(""))
    queries = {r: trigram_query(r.regex) for r in rules}
    tris = sorted({t for q in queries.values() for a in q for t in a})
    # one small expression over the list of trigrams; the outer function keeps the lowered text of a row
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, tris)).cast("array<string>"), lambda t: F.contains(low, t)))[0]
    scans = F.array(*[F.when(_may_match(F.col("text"), r), F.lit(f"scan:{r.kind}")) for r, q in queries.items() if not q])
    return (docs.select(text.alias("text"))
                .select(F.concat(held, F.array_compact(scans).cast("array<string>")).alias("terms"),
                        text_key(F.col("text")).alias("key"))
                .where(F.size("terms") > 0).distinct()
                .select(F.explode("terms").alias("term"), "key"))


def _may_match(text: Column, rule: Rule) -> Column:
    """Whole-text scan for a rule: a run of at least `min_len` characters of a
    one-class rule, else any match."""
    if rule.regex.endswith("]+") and rule.regex.startswith("[") and rule.group == 0 and rule.min_len:
        return F.rlike(text, F.lit(f"{rule.regex[:-1]}{{{rule.min_len}}}"))
    return F.rlike(text, F.lit(rule.regex))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): the rules each text is a candidate of, by intersecting
    postings. The ANDs of all rules go to the postings as a constant map from
    trigram to ANDs, so an AND holds where all its trigrams arrive."""
    ands: list[tuple[str, frozenset[str]]] = []
    for r in rules:
        ands += [(r.kind, a) for a in trigram_query(r.regex)] or [(r.kind, frozenset([f"scan:{r.kind}"]))]
    terms = sorted({t for _, a in ands for t in a})
    wanted = F.create_map(*[x for t in terms for x in (
        F.lit(t), F.array(*[F.lit(i) for i, (_, a) in enumerate(ands) if t in a]))])
    size = F.create_map(*[x for i, (_, a) in enumerate(ands) for x in (F.lit(i), F.lit(len(a)))])
    kind = F.create_map(*[x for i, (k, _) in enumerate(ands) for x in (F.lit(i), F.lit(k))])
    return (index.select("key", "term", F.explode(wanted[F.col("term")]).alias("conj"))
                 .groupBy("key", "conj").agg(F.count_distinct("term").alias("n"))
                 .where(F.col("n") == size[F.col("conj")])
                 .groupBy("key").agg(F.array_sort(F.collect_set(kind[F.col("conj")])).alias("kinds")))


# -------------------------------------------------------------- verification

def _matches(texts: DataFrame, rule: Rule, order: int) -> DataFrame:
    """(key, ord, kind, start, end) of the rule's matches in its candidates."""
    rx = F.lit(rule.regex)
    got = (texts.where(F.array_contains("kinds", rule.kind))
                .select("key", F.split("text", rule.regex, -1).alias("gaps"),
                        F.regexp_extract_all("text", rx, F.lit(0)).alias("m"),
                        F.regexp_extract_all("text", rx, F.lit(rule.group)).alias("g"))
                .select("key", F.posexplode(F.arrays_zip(
                    F.transform("gaps", lambda x: F.char_length(x)).alias("gap"),
                    F.transform("m", lambda x: F.char_length(x)).alias("len"),
                    F.transform("g", lambda x: F.char_length(x)).alias("glen")).alias("z")).alias("i", "z"))
                .where("z.len IS NOT NULL"))
    w = Window.partitionBy("key").orderBy("i")
    end = F.sum(F.col("z.gap") + F.col("z.len")).over(w)
    return (got.select("key", end.alias("end"), "z.len", "z.glen").where(F.col("glen") >= rule.min_len)
               .select("key", F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"),
                       (F.col("end") - F.col("len")).alias("start"), "end"))


def text_spans(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, spans ARRAY<STRUCT<start, ord, end, kind>>) of every text with a
    verified match, sorted by start and then by the rules' order."""
    rules = RULES if rules is None else rules
    cand = written(candidates(build_index(docs, text_col, rules), rules), "candidates")
    text = F.coalesce(col(text_col), F.lit(""))
    texts = (docs.select(text.alias("text"), text_key(text).alias("key")).join(cand, "key")
                 .groupBy("key").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds")))
    texts = written(texts, "candidate-texts")
    found = reduce(DataFrame.unionByName, [_matches(texts, r, i) for i, r in enumerate(rules)])
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("spans"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(id, spans): every document with its verified spans."""
    spans = written(text_spans(docs, text_col=text_col, rules=rules), "spans")
    none = F.array().cast(spans.schema["spans"].dataType)
    return (docs.select(col(id_col).alias("id"), text_key(col(text_col)).alias("key")).join(spans, "key", "left")
                .select("id", F.coalesce("spans", none).alias("spans")))


def drop_with_secrets(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The documents without any verified span, with their columns."""
    k = fresh(docs, "_secret_key")
    spans = written(text_spans(docs, text_col=text_col, rules=rules).select(F.col("key").alias(k)), "spans")
    return docs.join(spans, text_key(col(text_col)) == F.col(k), "left_anti")
