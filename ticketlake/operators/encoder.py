"""A text encoder trained on the corpus itself: hashed TF-IDF terms and a
truncated singular value decomposition.

Terms (tokens and token pairs) are hashed to `buckets` columns with a sign, and
weighed tf * idf with unit rows. The leading right singular vectors of the
sparse matrix A of all texts are found by randomised subspace iteration: Q is
replaced by an orthonormal basis of A^T (A Q) a few times, each product being
one pass over the rows, summed a bucket by Spark. Texts are encoded as the rows
of A times the basis, weighed alike.

The driver and every task hold buckets x (rank + `extra`) numbers (5 MB by
default, whatever the corpus) and nothing else; A is never gathered.

Defined cases: null and empty texts, and texts all of whose terms cancel, get a
zero vector; an empty corpus gives a basis of zeros; the rank is cut to the
buckets. Signs of singular vectors are fixed by their largest entry, so equal
corpora give equal encoders up to rounding.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.operators.postings import idf, term_hashes
from ticketlake.session import write_and_read

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Encoder:
    """`idf`: buckets, 0 where no text has a term; `basis`: buckets x rank;
    `strength`: singular values, descending."""
    idf: np.ndarray
    basis: np.ndarray
    strength: np.ndarray
    ngram_max: int


def hashed_rows(df: DataFrame, text: str, buckets: int, ngram_max: int, *keep: str) -> DataFrame:
    """`keep`, and ARRAY<LONG> of signed buckets: one entry a term."""
    t = term_hashes(df.select(*keep, F.col(text).alias("_text")), "_text", ngram_max, "_all")
    bucket = lambda h: F.pmod(h, F.lit(buckets)) + 1
    sign = lambda h: F.when(F.shiftrightunsigned(h, 63) == 1, -1).otherwise(1)
    return t.select(*keep, F.transform("_all", lambda h: bucket(h) * sign(h)).alias("_cols"))


def _sparse(cols: pa.Array, idf_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of a batch: signed counts times idf, unit rows."""
    sizes = np.diff(cols.offsets.to_numpy())
    row, signed = np.repeat(np.arange(len(sizes)), sizes), cols.flatten().to_numpy()
    n = len(idf_)
    cell, where = np.unique(row * n + np.abs(signed) - 1, return_inverse=True)
    w = np.bincount(where, weights=np.sign(signed), minlength=len(cell)) if len(cell) else np.zeros(0)
    row, col = cell // n, cell % n
    w = w * idf_[col]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(sizes)))
    return row, col, np.divide(w, norm[row], out=np.zeros_like(w), where=norm[row] > 0)


def _times(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The sparse rows times q."""
    out = np.zeros((n, q.shape[1]))
    if len(row):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[at]] = np.add.reduceat(w[:, None] * q[col], at)
    return out


def _gram_step(rows: DataFrame, idf_: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A^T (A q): a pass over the rows; buckets are summed by Spark."""
    width = q.shape[1]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hit = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cols = batch.column(0).slice(at, 1000)
                row, col, w = _sparse(cols, idf_)
                y = _times(row, col, w, len(cols), q)
                order = np.argsort(col, kind="stable")
                if len(order):
                    c = col[order]
                    starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    total[c[starts]] += np.add.reduceat(w[order][:, None] * y[row[order]], starts)
                    hit[c[starts]] = True
        some = np.flatnonzero(hit)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, j]) for j in range(width))],
                                             names=["b", *(f"v{j}" for j in range(width))])

    schema = "b int, " + ", ".join(f"v{j} double" for j in range(width))
    got = rows.mapInArrow(fn, schema).groupBy("b").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width))).toPandas()
    out = np.zeros_like(q)                              # at most a row a bucket
    out[got["b"].to_numpy().astype(int)] = got.drop(columns="b").to_numpy().astype(float)
    return out


def fit(corpus: DataFrame, text: str, *, rank: int = 32, buckets: int = 16_384, extra: int = 10, rounds: int = 3,
        ngram_max: int = 2, seed: int = 5) -> Encoder:
    """Encoder of the whole corpus, in `rounds` + 2 passes over its hashed rows."""
    rank = min(rank, buckets)
    rows = write_and_read(hashed_rows(corpus, text, buckets, ngram_max), "hashed")
    n = rows.count()
    per = rows.select(F.explode(F.array_distinct(F.transform("_cols", lambda x: F.abs(x) - 1))).alias("b")).groupBy("b").agg(
        F.count(F.lit(1)).alias("df")).select("b", idf(F.col("df"), n).alias("idf")).toPandas()       # at most a row a bucket
    idf_ = np.zeros(buckets)
    idf_[per["b"].to_numpy().astype(int)] = per["idf"].to_numpy()
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, min(buckets, rank + extra))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram_step(rows, idf_, q))[0]
    small = q.T @ _gram_step(rows, idf_, q)
    value, vec = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value)[:rank]
    basis = q @ vec[:, top]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] + 1e-300)
    strength = np.sqrt(np.maximum(value[top], 0))
    return Encoder(idf_, basis * (strength > 1e-9), strength, ngram_max)


def encode(df: DataFrame, text: str, encoder: Encoder, out: str = "vec") -> DataFrame:
    """Adds the ARRAY<DOUBLE> column `out`: the row of A times the basis."""
    enc_idf, basis = encoder.idf, encoder.basis
    rows = df.withColumn("_text", F.col(text))
    rows = term_hashes(rows, "_text", encoder.ngram_max, "_all")
    buckets = len(enc_idf)
    signed = F.transform("_all", lambda h: (F.pmod(h, F.lit(buckets)) + 1) * F.when(F.shiftrightunsigned(h, 63) == 1, -1).otherwise(1))

    @F.pandas_udf("array<double>")
    def vectors(cols: pd.Series) -> pd.Series:
        a = pa.array([np.asarray(x, np.int64) for x in cols], pa.list_(pa.int64()))
        row, col, w = _sparse(a, enc_idf)
        return pd.Series(list(_times(row, col, w, len(a), basis)))
    return rows.withColumn(out, vectors(signed)).drop("_text", "_all")


def featurizer(encoder: Encoder, text: str):
    """For `vectors.embed`: a function that adds the vector column."""
    return lambda df: encode(df, text, encoder)
