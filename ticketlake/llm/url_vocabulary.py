"""URL filters: host rules, then a weighted vocabulary.

A rule `host/path` with a verdict fits its host and every subdomain, where the
url's path starts with the rule's; the longest fitting rule decides. Urls that
no rule fits are judged by the words in them: an Aho-Corasick automaton finds
all strict and soft terms in the lower-cased (A-Z) url in one pass; a term
counts if it stands between characters other than a-z and 0-9 (or the ends).
One strict term, or `min_soft` distinct soft ones, block.

Map-only; the vocabulary comes as lists or from a table (`load_vocabulary`) whose
size is checked, and its automaton is built once a task. Defined cases: a null
url or one without `://` has empty host and path and is judged by its words alone
(none for null: allowed); repeated rows give a row each; rules of equal length go
by their order; very long urls are read whole; an empty table gives an empty
result. Only the url is read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value

by_value(__name__)

#: Defaults, stated plainly: (host, path, verdict), and the vocabulary.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
STRICT = ["casino", "escorts", "hentai", "porn", "viagra", "warez", "xxx"]
SOFT = ["adult", "bet", "betting", "cheap", "dating", "discount", "farm", "free", "loan", "loans", "nude", "pills", "poker",
        "sex", "slots", "spam", "torrent", "win", "winner"]

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path), both empty without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut].translate(_LOWER), rest[cut:]
    end = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return host, tail[:end]


def fitting_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equal lengths the first."""
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def load_vocabulary(table: DataFrame, max_terms: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table (term, weight 'strict' or 'soft'), A-Z
    lowered; nulls and empty terms are ignored. The terms go to every task, so
    their number is checked."""
    rows = table.where("term <> '' AND weight IN ('strict', 'soft')").select("term", "weight").distinct().limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"the vocabulary has over {max_terms} terms")
    terms = {w: sorted({r["term"].translate(_LOWER) for r in rows if r["weight"] == w}) for w in ("strict", "soft")}
    return terms["strict"], terms["soft"]


def automaton(strict: list[str], soft: list[str]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):     # a term in both lists is strict
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def term_hits(url: str | None, a) -> tuple[int, int]:
    """(distinct strict, distinct soft) terms that stand as words in the url."""
    text = (url or "").translate(_LOWER)
    plain = lambda i: not (0 <= i < len(text) and (text[i].isascii() and text[i].isalnum()))
    found = {hit for end, hit in a.iter(text) if plain(end + 1) and plain(end - len(hit[0]))} if len(a) else set()
    strict = sum(1 for _, w in found if w == 2)
    return strict, len(found) - strict


def judge(url: Column, *, rules: list[tuple[str, str, str]] | None = None, strict: list[str] | None = None,
          soft: list[str] | None = None, min_soft: int = 2) -> Column:
    """STRUCT of host, path, rule, verdict, n_strict and n_soft."""
    rules = RULES if rules is None else rules
    strict, soft = STRICT if strict is None else strict, SOFT if soft is None else soft

    @F.pandas_udf("host string, path string, rule string, verdict string, n_strict long, n_soft long")
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)                 # once a task
        for urls in batches:
            out = []
            for u in urls:
                u = None if u is None else str(u)
                host, path = split_url(u)
                rule = fitting_rule(host, path, rules) if host else None
                s, w = term_hits(u, a)
                out.append((host, path, rule[0] if rule else None,
                            rule[1] if rule else "block" if s or w >= min_soft else "allow", s, w))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft"])
    return verdicts(url)
