"""Exact top-k by cosine that skips cells of candidates.

Centroids are fitted on a bounded sample; every candidate belongs to its nearest
centroid and, by its distance from it, to one of a few rings. A cell (centroid,
ring) holds candidates at distances lo to hi from the centroid m, so for a unit
query q no candidate x of it is nearer than max(0, |q - m| - hi, lo - |q - m|)
(the triangle inequality), and with |q - x|^2 = 2 - 2 q.x no score is above
1 - nearest^2 / 2. Each query first scans the cells of the best bounds that
together hold a few times k candidates; its k-th score there decides which other
cells it must scan. The sample only shapes the cells: every row is indexed and
no result can be lost.

The driver holds the centroids and a row a cell (`centroids` x `rings`, both
parameters). Neighbouring cells share a block of about `block_rows` rows, larger
cells are dealt over several, and so are the queries of a block that many must
scan. A query is sent once to each block with the list of its cells there, so
where bounds skip nothing no more is moved than by a plain blocked join.

Defined cases are those of `vectors.block_topk`; zero vectors form a cell of
their own, whose bound is a score of 0, and a zero query scans every cell.
Candidates whose width differs from the first one's are refused with an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.operators.vectors import Best, _by_id, _dense, _unit
from ticketlake.session import write_and_read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = 1e-9


@dataclass
class Cells:
    """`rows`: id, vec (unit or zero), cell, block; `table`: a numpy record a
    cell that holds rows (cell, centroid, lo, hi, n, salts, block: its first)."""
    rows: DataFrame
    centroids: np.ndarray
    table: np.ndarray


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Plain k-means over unit vectors; an emptied centroid takes the row that
    is farthest from its own."""
    r = np.random.default_rng(seed)
    c = sample[r.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        s = sample @ c.T - 0.5 * (c * c).sum(1)
        own = s.argmax(1)
        n_own = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        c = np.where(n_own[:, None] > 0, total / np.maximum(n_own, 1)[:, None], c)
        for e in np.flatnonzero(n_own == 0):
            far = s[np.arange(len(sample)), own].argmin()
            c[e] = sample[far]
            s[far] = np.inf
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))


def build_cells(cands: DataFrame, *, centroids: int = 256, rings: int = 8, sample_rows: int = 20_000, block_rows: int = 16_384) -> Cells:
    """Deals every candidate (id, vec) to its cell; `sample_rows` bounds the
    rows that the centroids are fitted on."""
    rows = cands.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"))
    some = rows.orderBy(F.xxhash64("id", "vec")).limit(sample_rows).select("vec").toPandas()
    sample = _unit(_dense(some, "dense", None)) if len(some) else np.zeros((0, 0))
    sample = sample[(sample != 0).any(1)] if len(sample) else sample
    c = fit_centroids(sample, min(centroids, max(1, len(sample) // 8))) if len(sample) else np.zeros((0, sample.shape[1]))
    step = 2.0 / rings

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _unit(_dense(f, "dense", None))
                own, far = np.full(len(x), -1), np.zeros(len(x))
                live = (x != 0).any(1)
                if live.any() and len(c):
                    d = _distances(x[live], c)
                    own[live] = d.argmin(1)
                    far[live] = d.min(1)
                ring = np.minimum((far / step).astype(int), rings - 1)
                yield pd.DataFrame({"id": f["id"], "vec": list(x), "cell": np.where(own < 0, -1, own * rings + ring), "far": far})

    schema = T.StructType([rows.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    dealt = write_and_read(rows.mapInPandas(deal, schema), "cells")
    # a row a cell: at most centroids x rings + 1
    per = dealt.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    table = np.zeros(len(per), [("cell", int), ("centroid", int), ("lo", float), ("hi", float), ("n", int), ("salts", int), ("block", int)])
    block = held = 0
    for t, r in zip(table, per):
        salts = -(-r["n"] // block_rows)
        if held and (salts > 1 or held + r["n"] > block_rows):
            block, held = block + 1, 0
        t["cell"], t["centroid"], t["lo"], t["hi"], t["n"] = r["cell"], r["cell"] // rings if r["cell"] >= 0 else -1, r["lo"], r["hi"], r["n"]
        t["salts"], t["block"] = salts, block
        block, held = (block + salts, 0) if salts > 1 else (block, held + r["n"])
    where = dealt.sparkSession.createDataFrame([(int(t["cell"]), int(t["salts"]), int(t["block"])) for t in table], "cell int, salts int, first int")
    keyed = dealt.join(F.broadcast(where), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id", "vec"), "salts")).cast("int"))
    return Cells(keyed.select("id", "vec", "cell", "block"), c, table)


def upper_bounds(q: np.ndarray, c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(queries x cells): no candidate of the cell scores above."""
    out = np.zeros((len(q), len(table)))
    real = table["centroid"] >= 0
    if real.any() and len(q):
        d = _distances(q, c)[:, table["centroid"][real]]
        near = np.maximum(0, np.maximum(d - table["hi"][real], table["lo"][real] - d))
        out[:, real] = 1 - near ** 2 / 2
    out[~(q != 0).any(1)] = 0               # a zero query scores 0 with everything
    return out


def pruned_topk(queries: DataFrame, cells: Cells, k: int, *, exclude_self: bool = False, block_rows: int = 16_384, first: int = 4,
                q_name: str = "query_id", c_name: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """((q_name, c_name, rank, score), (cell, scanned)): the exact top k of
    every query by cosine, ties by candidate id, and how many queries had to
    scan each cell. `first` times k candidates give a query its first bound."""
    c, table = cells.centroids, cells.table
    q = queries.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"))
    q = write_and_read(q.withColumn("qrid", F.monotonically_increasing_id()), "queries")
    spark, id_q, id_c = q.sparkSession, q.schema["id"].dataType, cells.rows.schema["id"].dataType
    hit = T.StructType([T.StructField("q", T.LongType()), T.StructField("c", id_c), T.StructField("score", T.DoubleType())])

    def plan(least: bool):
        """(qrid, id, vec, block, cells) of the cells that a query must scan:
        first without a bound, then with its k-th score."""
        def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), 256):
                    part = f.iloc[at:at + 256]
                    ub = upper_bounds(_unit(_dense(part, "dense", None)), c, table)
                    order = np.argsort(-ub, axis=1, kind="stable")
                    seen = np.cumsum(table["n"][order], axis=1) - table["n"][order]
                    early = np.zeros_like(ub, bool)
                    np.put_along_axis(early, order, seen < first * k, axis=1)
                    take = (~early & (ub >= part["least"].to_numpy()[:, None] - EPS)) if least else early
                    qi, ci = np.nonzero(take)
                    salts = table["salts"][ci]          # a cell of several blocks is scanned in each
                    nth = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                    qi, ci = np.repeat(qi, salts), np.repeat(ci, salts)
                    block = table["block"][ci] + nth
                    new = np.flatnonzero((np.diff(qi, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))     # blocks ascend with cells
                    yield pd.DataFrame({"qrid": part["qrid"].to_numpy()[qi[new]], "id": part["id"].to_numpy()[qi[new]],
                                        "vec": [part["vec"].iloc[i] for i in qi[new]], "block": block[new],
                                        "cells": np.split(table["cell"][ci], new[1:]) if len(new) else []})
        return fn

    def scan(want: DataFrame) -> tuple[DataFrame, DataFrame]:
        want = write_and_read(want, "scans")
        # a row a cell: how many queries scan it
        several = [int(t["cell"]) for t in table if t["salts"] > 1]
        firsts = F.when(F.col("cell").isin(several), F.col("block") == F.element_at(F.create_map(
            *[F.lit(int(x)) for t in table if t["salts"] > 1 for x in (t["cell"], t["block"])]), F.col("cell"))).otherwise(True) if several else F.lit(True)
        load = want.select("block", F.explode("cells").alias("cell")).where(firsts).groupBy("cell").agg(F.count(F.lit(1)).alias("scanned"))
        # a row a block: into how many parts its queries are dealt
        salts = [(r["block"], -(-r["n"] // block_rows)) for r in want.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
        keys = lambda: F.broadcast(spark.createDataFrame(salts, "block int, q_salts int"))
        tasks = min(2000, max(sum(n for _, n in salts), 2 * spark.sparkContext.defaultParallelism))
        left = want.join(keys(), "block").withColumn("qs", F.pmod(F.xxhash64("qrid"), "q_salts").cast("int")).drop("q_salts")
        right = cells.rows.join(keys(), "block").withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("q_salts") - 1))).drop("q_salts")

        def fn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if len(a) == 0 or len(b) == 0:
                return pd.DataFrame({"q": pd.Series([], dtype="int64"), "c": b["id"].iloc[:0], "score": pd.Series([], dtype="float64")})
            Q, qid, best = _unit(_dense(a, "dense", None)), a["id"].to_numpy(), Best(len(a), k)
            n_cells = a["cells"].map(len).to_numpy()
            row, cell = np.repeat(np.arange(len(a)), n_cells), np.concatenate(a["cells"].to_numpy())
            order = np.argsort(cell, kind="stable")
            row, cell = row[order], cell[order]
            b = b.iloc[_by_id(b["id"])]
            for e, part in b.groupby("cell"):
                of = row[np.searchsorted(cell, e):np.searchsorted(cell, e, side="right")]
                for lo in range(0, len(part), 2048):
                    some = part.iloc[lo:lo + 2048]
                    C, cid = _dense(some, "dense", None), some["id"].to_numpy()
                    for at in range(0, len(of), 1024):
                        rows = of[at:at + 1024]
                        S = Q[rows] @ C.T
                        if exclude_self:
                            S[qid[rows][:, None] == cid[None, :]] = -np.inf
                        best.add(rows, S, cid)
            q, c_, s = best.rows()
            return pd.DataFrame({"q": a["qrid"].to_numpy()[q], "c": c_, "score": s})
        by = ["block", "qs"]
        return left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(fn, hit), load

    want = T.StructType([T.StructField("qrid", T.LongType()), T.StructField("id", id_q), T.StructField("vec", T.ArrayType(T.DoubleType())),
                         T.StructField("block", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("c"))
    if len(table) == 0:
        return (spark.createDataFrame([], T.StructType([T.StructField(q_name, id_q), T.StructField(c_name, id_c), T.StructField("rank", T.IntegerType()),
                                                        T.StructField("score", T.DoubleType())])),
                spark.createDataFrame([], "cell int, scanned long"))
    early, load1 = scan(q.mapInPandas(plan(False), want))
    early = write_and_read(early.withColumn("rank", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k).drop("rank"), "early")
    nth = early.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("q").alias("qrid"), F.col("score").alias("least"))
    later, load2 = scan(q.join(nth, "qrid", "left").fillna({"least": -2.0}).mapInPandas(plan(True), want))
    hits = early.unionByName(later).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = hits.join(q.select(F.col("qrid").alias("q"), F.col("id").alias(q_name)), "q")
    return (out.select(q_name, F.col("c").alias(c_name), "rank", "score"),
            load1.unionByName(load2).groupBy("cell").agg(F.sum("scanned").alias("scanned")))
