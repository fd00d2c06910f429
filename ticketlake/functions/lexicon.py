"""Keyword labels by a lexicon of any size.

`text.keyword_scores` writes one test a keyword into the expression, which is
fastest for a hundred keywords and no longer compiles for thousands. Here the
lexicon is a table (label, pos, keyword); every task builds one automaton of all
keywords, reads each text once, and counts the distinct keywords of every label
that it holds. The rule is that of the expression: substrings of the lowered
text; a keyword that a label lists twice counts twice; the most hits win, ties go
to the label with the least pos; no hit or a null text gives the default.

The lexicon goes to every task, so its size is checked against `max_keywords`.

Defined cases: empty keywords stand in every text; null keywords, labels and
positions are ignored; an empty lexicon gives the default.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lexicon_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """(label, pos, keyword) of an ordered lexicon."""
    rows = [(label, i, k) for i, (label, kws) in enumerate(lexicon.items()) for k in kws]
    return spark.createDataFrame(rows, "label string, pos int, keyword string")


def label_by_lexicon(text: Column, lexicon: DataFrame, default: str, max_keywords: int = 1_000_000) -> Column:
    """STRUCT of label and hits."""
    rows = lexicon.where("label IS NOT NULL AND pos IS NOT NULL AND keyword IS NOT NULL").groupBy("label", "pos", "keyword").agg(
        F.count(F.lit(1)).alias("n")).limit(max_keywords + 1).collect()
    if len(rows) > max_keywords:
        raise ValueError(f"the lexicon has over {max_keywords} keywords")
    labels = sorted({(r["pos"], r["label"]) for r in rows})
    number = {x: i for i, x in enumerate(labels)}
    gives: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        gives.setdefault(r["keyword"], []).append((number[r["pos"], r["label"]], r["n"]))
    names, always = [x for _, x in labels], gives.pop("", [])

    @F.pandas_udf("label string, hits int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, (k, v) in enumerate(gives.items()):
            a.add_word(k, (i, v))
        if gives:
            a.make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append((default, 0))
                    continue
                hits: dict[int, int] = {}
                for label, n in always:
                    hits[label] = hits.get(label, 0) + n
                for v in (dict(x for _, x in a.iter(t)).values() if gives else ()):
                    for label, n in v:
                        hits[label] = hits.get(label, 0) + n
                best = min(hits.items(), key=lambda x: (-x[1], x[0])) if hits else None
                out.append((names[best[0]], best[1]) if best else (default, 0))
            yield pd.DataFrame(out, columns=["label", "hits"])
    return score(F.lower(text))
