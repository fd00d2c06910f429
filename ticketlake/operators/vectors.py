"""Vectors and exact top-k similarity search.

Exact top-k by inner product runs as a blocked nested loop: queries are
hash-split into blocks of at most `block_rows` rows and candidates into
blocks sized by their stored bytes; every (query block, candidate block)
pair meets once in a cogrouped pandas task that densifies the candidate
block chunk by chunk, does one numpy matmul per chunk and 1,024 queries and
keeps each query's top-k, ties by id. A final `row_number() <= k` (a
literal, so Spark pre-limits per partition) merges the block winners. No
pair table is ever materialised, task memory is bounded by the query block
and one chunk, and an optional equality constraint (`part`) is applied
inside each block pair, so a hot part value cannot create a hot task.

Defined cases, alike on every path: a null vector is neither a query nor a
candidate, a null `part` matches nothing, a zero vector scores 0 with
everything, and an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import cloudpickle

# ship the block kernel with the task (pickled by value), so executors do
# not need this package installed or on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def embed(df: DataFrame, featurizer, out: str = "vec") -> DataFrame:
    """Adds the vector column `out`: from a column expression or name, or from
    a function DataFrame -> DataFrame (an ML pipeline's `transform`, a
    `mapInPandas` batch model) that adds it. Unit length is `block_topk`'s."""
    if callable(featurizer):
        got = featurizer(df)
        if out not in got.columns:
            raise ValueError(f"the featurizer adds no column {out!r}")
        return got
    return df.withColumn(out, F.col(featurizer) if isinstance(featurizer, str) else featurizer)


def _dense(pdf: pd.DataFrame, kind: str, dim: int | None) -> np.ndarray:
    if kind == "dense":
        if len(pdf) == 0:
            return np.zeros((0, 0))
        return np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
    m = np.zeros((len(pdf), dim), dtype=np.float64)
    for i, (idx, val) in enumerate(zip(pdf["idx"], pdf["val"])):
        if idx is not None and len(idx):
            m[i, np.asarray(idx, dtype=np.int64)] = np.asarray(val, dtype=np.float64)
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    np.divide(m, n, out=m, where=n > 0)
    return m


def _useful(S: np.ndarray, k: int, min_score: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores, ties by column; scores
    under the floor are no candidates."""
    if min_score is not None:
        S[S < min_score] = -np.inf
    kk = min(k, S.shape[1])
    kth = np.partition(S, S.shape[1] - kk, axis=1)[:, S.shape[1] - kk, None]
    take = (S >= kth) & np.isfinite(S)
    for i in np.flatnonzero(take.sum(1) > kk):
        above, tie = S[i] > kth[i], S[i] == kth[i]
        take[i] = above | (tie & (np.cumsum(tie) <= kk - above.sum()))
    return np.nonzero(take)


def _by_id(ids: pd.Series) -> np.ndarray:
    """Positions in the order of the ids, nulls first (as Spark sorts them)."""
    return ids.reset_index(drop=True).sort_values(kind="stable", na_position="first").index.to_numpy()


class Best:
    """The k best candidates so far of every query of a block, ties by id. It
    holds at most 5 k rows a query, however many candidates and equal scores
    there are: a score under a query's k-th is not kept."""

    def __init__(self, n: int, k: int, min_score: float | None = None):
        self.k, self.min_score = k, min_score
        self.least = np.full(n, -np.inf if min_score is None else min_score)
        self.q, self.c, self.s, self.held, self.added = np.zeros(0, np.int64), None, np.zeros(0), [], 0

    def add(self, rows: np.ndarray, S: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries `rows` with candidates in the order of their
        ids; -inf marks pairs that do not count."""
        least = self.least[rows]
        q, c = np.nonzero((S >= least[:, None] - 1e-12) & np.isfinite(S))
        if len(q) > 4 * self.k * len(S):
            q, c = _useful(np.round(S, 12), self.k, self.min_score)
        s = np.round(S[q, c], 12)
        keep = s >= least[q]
        self.held.append((rows[q[keep]], ids[c[keep]], s[keep]))
        self.added += int(keep.sum())
        if self.added > 4 * self.k * len(self.least):
            self.trim()

    def trim(self) -> None:
        ids = [x for x in (self.c, *(h[1] for h in self.held)) if x is not None]
        if not ids:
            return
        q, c, s = np.concatenate([self.q, *(h[0] for h in self.held)]), np.concatenate(ids), np.concatenate([self.s, *(h[2] for h in self.held)])
        rank = np.empty(len(c), np.int64)
        rank[_by_id(pd.Series(c))] = np.arange(len(c))
        order = np.lexsort((rank, -s, q))
        q, c, s = q[order], c[order], s[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        kth = nth == self.k - 1
        self.least[q[kth]] = s[kth]
        self.q, self.c, self.s = q[nth < self.k], c[nth < self.k], s[nth < self.k]
        self.held, self.added = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate id, score)."""
        self.trim()
        return self.q, self.c if self.c is not None else np.zeros(0), self.s


def _scan_fn(q: pd.DataFrame, k: int, kind: str, dim: int | None, exclude_self: bool, normalize: bool,
             min_score: float | None, part: str | None, chunk_rows: int):
    """Scan of a candidate partition against all queries at once: a task holds
    the queries, one chunk and the best rows."""
    Q = _dense(q, kind, dim)
    if normalize and len(Q):
        Q = _unit(Q)
    qid = q["id"].to_numpy()
    qpart = q[part].to_numpy() if part else None
    chunk_rows = max(16, min(chunk_rows, (32 << 20) // (8 * max(1, len(q)))))      # scores of a chunk: 32 MB

    def fn(frames):
        best = Best(len(Q), k, min_score)
        for frame in frames:
            for start in range(0, len(frame), chunk_rows):
                c = frame.iloc[start:start + chunk_rows]
                c = c.iloc[_by_id(c["id"])]
                if kind == "dense":
                    C = _dense(c, kind, dim)
                    S = Q @ (_unit(C) if normalize else C).T
                else:       # only the columns that a candidate has
                    S = np.stack([Q[:, np.asarray(i, np.int64)] @ np.asarray(v, np.float64) if i is not None and len(i)
                                  else np.zeros(len(Q)) for i, v in zip(c["idx"], c["val"])], 1)
                cid = c["id"].to_numpy()
                if exclude_self:
                    S[qid[:, None] == cid[None, :]] = -np.inf
                if part:
                    S[qpart[:, None] != c[part].to_numpy()[None, :]] = -np.inf
                best.add(np.arange(len(Q)), S, cid)
        q, c, s = best.rows()
        if len(q):
            yield pd.DataFrame({"q": qid[q], "c": c, "score": s})
    return fn


def _block_fn(k: int, kind: str, dim: int | None, exclude_self: bool, normalize: bool, chunk_rows: int,
              min_score: float | None = None):
    """Per (query block, candidate block): densify the candidate block chunk
    by chunk, one matmul per chunk and 1,024 queries, keep each query's top-k.
    A task holds its two blocks, whose rows are bounded by the block sizes, one
    tile of scores and the best rows."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"q": pd.Series([], dtype=object), "c": pd.Series([], dtype=object),
                                 "score": pd.Series([], dtype="float64")})
        Q = _dense(q, kind, dim)
        if normalize:
            Q = _unit(Q)
        qid, c, best = q["id"].to_numpy(), c.iloc[_by_id(c["id"])], Best(len(q), k, min_score)
        for start in range(0, len(c), chunk_rows):
            part = c.iloc[start:start + chunk_rows]
            C = _dense(part, kind, dim)
            if normalize:
                C = _unit(C)
            cid = part["id"].to_numpy()
            for at in range(0, len(Q), 1024):
                S = Q[at:at + 1024] @ C.T
                if exclude_self:
                    S[qid[at:at + 1024, None] == cid[None, :]] = -np.inf
                best.add(np.arange(at, at + len(S)), S, cid)
        qi, ci, s = best.rows()
        return pd.DataFrame({"q": qid[qi], "c": ci, "score": s})
    return fn


def block_topk(queries: DataFrame, cands: DataFrame, k: int, *, kind: str = "dense", dim: int | None = None,
               part: str | None = None, exclude_self: bool = False, normalize: bool = True,
               block_rows: int = 16384, cand_block_bytes: int = 16 << 20, chunk_rows: int = 2048,
               min_score: float | None = None, scan_bytes: int = 4 << 20,
               q_name: str = "query_id", c_name: str = "case_id") -> DataFrame:
    """Exact top-k per query by inner product (cosine when `normalize`).

    queries / cands: columns `id` plus `vec` (dense ARRAY) or `idx`/`val`
    (sparse ARRAY<INT>/ARRAY<DOUBLE>, `dim` required), and `part` when given
    (candidates must share the query's part value: a pre-filter).
    Returns (q_name, c_name, rank, score) with ties broken by candidate id.

    Queries that take at most `scan_bytes` as a dense matrix (measured) go to
    every task, and the candidates are scanned where they are: neither side is
    copied or shuffled. Beyond that, query blocks hold at most `block_rows` rows; candidate blocks are sized
    by their stored bytes (`cand_block_bytes`, from a measured average row
    size). Each query is shuffled once per candidate block and each candidate
    once per query block.
    """
    vcols = ["vec"] if kind == "dense" else ["idx", "val"]
    pcols = [part] if part else []
    queries, cands = (t.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [vcols[0], *pcols]])) for t in (queries, cands))
    width = F.size(vcols[0])
    schema = T.StructType([T.StructField("q", queries.schema["id"].dataType), T.StructField("c", cands.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("c"))
    qstats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("w")).first()
    nq = qstats["n"]
    if nq == 0:
        return queries.sparkSession.createDataFrame([], schema).select(
            F.col("q").alias(q_name), F.col("c").alias(c_name), F.lit(0).alias("rank"), "score")
    if nq * (dim or qstats["w"] or 1) * 8 <= scan_bytes:
        few = queries.select("id", *vcols, *pcols).toPandas()           # bounded by scan_bytes
        hits = cands.select("id", *vcols, *pcols).mapInPandas(
            _scan_fn(few, k, kind, dim, exclude_self, normalize, min_score, part, chunk_rows), schema)
        return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                    .select(F.col("q").alias(q_name), F.col("c").alias(c_name), "rank", "score"))
    cstats = cands.agg(F.count(F.lit(1)).alias("n"), F.avg(width).alias("w")).first()
    nc, avg_w = cstats["n"], float(cstats["w"] or 1.0)
    row_bytes = 16 + avg_w * (8 if kind == "dense" else 12)
    c_rows = max(chunk_rows, int(cand_block_bytes // row_bytes))
    qb, cb = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nc / c_rows))
    q = (queries.select("id", *vcols, *pcols)
                .withColumn("qblk", F.pmod(F.xxhash64("id"), F.lit(qb)))
                .withColumn("cblk", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)).cast("array<long>"))))
    c = (cands.select("id", *vcols, *pcols)
              .withColumn("cblk", F.pmod(F.xxhash64("id"), F.lit(cb)))
              .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<long>"))))
    keys = ["qblk", "cblk", *pcols]
    # blocks are few and small but long to work on: their number, not their bytes, decides the tasks
    tasks = max(qb * cb, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    q, c = q.repartition(min(tasks, 2000), *keys), c.repartition(min(tasks, 2000), *keys)
    hits = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(
        _block_fn(k, kind, dim, exclude_self, normalize, chunk_rows, min_score), schema)
    return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(F.col("q").alias(q_name), F.col("c").alias(c_name), "rank", "score"))


def filtered_topk(queries: DataFrame, cands: DataFrame, k: int, part: str, *, mode: str = "pre",
                  **kw) -> DataFrame:
    """Top-k among candidates sharing the query's `part` value.

    mode="pre": exact (filter, then rank). mode="post": fetch the top
    min(3k, N) over all candidates, then keep those in the query's part, so
    fewer than k may remain (the over-fetch rule). Ranks are renumbered
    after the filter."""
    if mode == "pre":
        return block_topk(queries, cands, k, part=part, **kw)
    if mode != "post":
        raise ValueError(mode)
    q_name, c_name = kw.get("q_name", "query_id"), kw.get("c_name", "case_id")
    wide = block_topk(queries.drop(part), cands.drop(part), 3 * k, **kw)
    qp = queries.select(F.col("id").alias(q_name), F.col(part).alias("_qp"))
    cp = cands.select(F.col("id").alias(c_name), F.col(part).alias("_cp"))
    kept = wide.join(qp, q_name).join(cp, c_name).filter(F.col("_qp") == F.col("_cp"))
    w = Window.partitionBy(q_name).orderBy("rank")
    return (kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(q_name, c_name, "rank", "score"))
