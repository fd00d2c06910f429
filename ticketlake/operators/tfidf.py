"""TF-IDF vocabulary (retrieval is in `postings.py`).

Tokens: lower-cased runs of two or more letters/digits/underscores (the
Unicode reading of `\\b\\w\\w+\\b`); optional stop-word removal, then n-grams
over the remaining tokens. idf = ln((1+n)/(1+df)) + 1. The vocabulary is cut by
document frequency and then to the `max_features` most frequent terms (ties by
term), so it has a proven size bound and can be broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.session import cut_lineage

# ship the kernels with the task (pickled by value)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = r"[\p{L}\p{N}_]{2,}"


# --------------------------------------------------------------------------
# FIXED VALUES: Spark ML's default English stop-word list, so that the Spark
# featuriser and the SQL oracle use the same words without reading a jar.
# --------------------------------------------------------------------------
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH_STOP_WORDS


def term_arrays(df: DataFrame, text: str, ngram_max: int = 2, stop_words: bool = False) -> DataFrame:
    """Adds `terms` ARRAY<STRING>: unigrams (+ bigrams) of the text."""
    out = df.withColumn("_tok", F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)))
    if stop_words:
        out = StopWordsRemover(inputCol="_tok", outputCol="_tok2", stopWords=list(english_stop_words()),
                               caseSensitive=True).transform(out).drop("_tok").withColumnRenamed("_tok2", "_tok")
    t = F.col("_tok")
    terms = t
    if ngram_max >= 2:
        n = F.size(t)
        bi = F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1),
                        lambda a, b: F.concat(a, F.lit(" "), b))
        terms = F.when(n >= 2, F.concat(t, bi)).otherwise(t)
    return out.withColumn("terms", terms).drop("_tok")


def _count_terms(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(term, total, df) of runs of rows that hold about `most` terms."""
    for batch in batches:
        all_ = batch.column(0)
        ends = all_.offsets.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff((ends[1:] - ends[0]) // most)) + 1).tolist(), len(all_)]
        for lo, hi in zip(cuts, cuts[1:]):
            run = all_.slice(lo, hi - lo)
            size = pa.compute.fill_null(pa.compute.list_value_length(run), 0).to_numpy(zero_copy_only=False)
            terms = run.flatten().dictionary_encode()
            n = len(terms.dictionary)
            if n:
                code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.unique(np.repeat(np.arange(len(size)), size) * n + code) % n      # each row once a term
                yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.bincount(code, minlength=n)),
                                                  pa.array(np.bincount(rows, minlength=n))], names=["term", "total", "df"])


def _fit(terms: DataFrame, n_docs: int, *, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """Vocabulary from per-row term arrays: corpus frequency counts every
    occurrence, document frequency each row once; both are counted inside the
    tasks and summed in one aggregation over terms."""
    n = F.lit(float(n_docs))
    counts = (terms.select("terms").mapInArrow(_count_terms, "term string, total long, df long")
                   .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
    kept = counts.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    top = kept.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    # bounded by max_features: the index window runs on at most that many rows
    return top.select("term", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
                      (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("tidx"))


def fit_vocabulary(docs: DataFrame, key: str, text: str, *, ngram_max: int = 2, stop_words: bool = False,
                   min_df: int = 1, max_df: float = 1.0, max_features: int = 5000) -> DataFrame:
    """(term, df, idf, tidx) over the corpus; at most `max_features` rows,
    materialised in the checkpoint folder. The term arrays are read once, by
    the count, and kept nowhere."""
    t = term_arrays(docs.select(key, text), text, ngram_max, stop_words)
    return cut_lineage(_fit(t, docs.select(key).count(), min_df=min_df, max_df=max_df, max_features=max_features))
