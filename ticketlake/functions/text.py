"""Column helpers shared by the operators. All are built-in expressions, so
they stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS_EDGES = r"^\s+|\s+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each. The optimizer copies
    an expression into every filter and column that reads it; through a
    generator it copies nothing, so costly columns are computed once a row."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def strip_ws(c: str | Column) -> Column:
    """Whitespace strip on both ends (Spark `trim` removes spaces only)."""
    return F.regexp_replace(col(c), WS_EDGES, "")


def lower_text(c: str | Column) -> Column:
    """Lower-cased text, null -> ''."""
    return F.lower(F.coalesce(col(c), F.lit("")))


def contains_any(lowered: Column, keywords: Sequence[str]) -> Column:
    """True when any keyword is a substring (plain substring, not word)."""
    if not keywords:
        return F.lit(False)
    out = None
    for kw in keywords:
        term = lowered.contains(kw)
        out = term if out is None else (out | term)
    return out


def count_hits(lowered: Column, keywords: Sequence[str]) -> Column:
    """Number of keywords that occur; a keyword listed twice counts twice."""
    if not keywords:
        return F.lit(0)
    out = None
    for kw in keywords:
        term = lowered.contains(kw).cast("int")
        out = term if out is None else (out + term)
    return out


def keyword_scores(lowered: Column, lexicon: dict[str, Sequence[str]]) -> list[tuple[str, Column]]:
    return [(label, count_hits(lowered, kws)) for label, kws in lexicon.items()]


def best_label(scores: list[tuple[str, Column]], default: str) -> tuple[Column, Column]:
    """(label, best score): max score wins, ties go to the earlier label,
    no hit -> default. One `array_max` over (score, -position, label)
    structs, so each keyword test appears once in the generated code."""
    top = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("p"), F.lit(name).alias("l"))
                                for i, (name, s) in enumerate(scores)]))
    return F.when(top["s"] > 0, top["l"]).otherwise(F.lit(default)), top["s"]


def word_count(c: str | Column) -> Column:
    """Whitespace token count, as `len(str.split())`; null -> null."""
    s = strip_ws(col(c))
    return F.when(s.isNull(), F.lit(None).cast("int")) \
        .when(s == "", F.lit(0)) \
        .otherwise(F.size(F.split(s, r"\s+")))
