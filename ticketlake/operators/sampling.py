"""Repeatable sampling, stratified allocation, stratified samples and splits.

Randomness is the MD5 of `seed:key`, so a sample depends on neither
partitioning nor row order, every seed gives another sample, ids spread over
the whole key range, and any engine with MD5 draws the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake import lexicons as L
from ticketlake.functions.text import contains_any, count_hits, word_count

HASH_BITS = 60      # fifteen hexadecimal digits
BUCKET_BITS = 20


def seeded_hash(key: str | Column, seed: int) -> Column:
    """Pseudo-random order key in [0, 2^60) from a key of any simple type."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (all rows when fewer): top-n by hash, which
    Spark runs as a per-partition top-n plus a merge (no global sort)."""
    return df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def difficulty(text: str, turns: str, connectors: Sequence[str] = L.DIFFICULTY_CONNECTORS, angry: Sequence[str] = L.DIFFICULTY_ANGRY) -> Column:
    """hard, medium or easy: 2 points for under 5 words, 1 each for more than
    one connector, an angry word, and over 5 turns."""
    low = F.lower(text)
    score = (F.when(word_count(text) < 5, 2).otherwise(0) + F.when(count_hits(low, connectors) > 1, 1).otherwise(0)
             + F.when(contains_any(low, angry), 1).otherwise(0) + F.when(F.col(turns) > 5, 1).otherwise(0))
    return F.when(score >= 3, "hard").when(score >= 1, "medium").otherwise("easy")


def exact_allocation(df: DataFrame, label: str, n: int, minimum: int = 5) -> DataFrame:
    """(label, n_rows, alloc) like `stratified_allocation`, but the total is n
    wherever the labels hold enough rows: what is over or missing after the
    first round goes to the labels one by one, the largest remainders of their
    shares first, never below `minimum` nor above the label's rows. The table
    is one row a label, so it is settled on the driver."""
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows")).collect()
    total = sum(r["n_rows"] for r in rows)
    want = min(n, total)
    share = {r["label"]: want * r["n_rows"] / total for r in rows}
    size = {r["label"]: r["n_rows"] for r in rows}
    alloc = {k: min(size[k], max(minimum, int(share[k]))) for k in size}
    order = sorted(size, key=lambda k: (-(share[k] - int(share[k])), -size[k], k is None, k or ""))
    low = {k: min(size[k], minimum) for k in size}
    while sum(alloc.values()) != want:
        step = 1 if sum(alloc.values()) < want else -1
        free = [k for k in (order if step > 0 else reversed(order)) if (alloc[k] < size[k] if step > 0 else alloc[k] > low[k])]
        if not free:
            break               # `minimum` rows of every label are already more than n
        for k in free[:abs(want - sum(alloc.values()))]:
            alloc[k] += step
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame([(k, size[k], alloc[k]) for k in size], f"label {kind}, n_rows long, alloc long")


def stratified_allocation(df: DataFrame, label: str, n: int, minimum: int = 5) -> DataFrame:
    """(label, n_rows, alloc): min(count, max(minimum, int(n*share))), then one
    +1 (residual > 0) or one -1 floored at `minimum` (residual < 0) for each of
    the |residual| most common labels (ties by label). The table is one row
    per label, so the global windows below run on a label-sized input."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    allw = Window.partitionBy()
    total = F.sum("n_rows").over(allw)
    base = F.least(F.col("n_rows"), F.greatest(F.lit(minimum),
                                               F.floor(F.lit(n) * (F.col("n_rows") / total)).cast("long")))
    a = counts.withColumn("base", base)
    resid = F.lit(n) - F.sum("base").over(allw)
    rank = F.row_number().over(Window.orderBy(F.desc("n_rows"), F.asc("label")))
    a = a.withColumn("resid", resid).withColumn("rk", rank)
    adj = (F.when((F.col("resid") > 0) & (F.col("rk") <= F.col("resid")), F.col("base") + 1)
           .when((F.col("resid") < 0) & (F.col("rk") <= -F.col("resid")),
                 F.greatest(F.lit(minimum), F.col("base") - 1))
           .otherwise(F.col("base")))
    return a.select("label", "n_rows", adj.cast("long").alias("alloc"))


def _lowest(df: DataFrame, label: str, key: str, need: DataFrame, seed: int) -> DataFrame:
    """`df` with `_h` and `_take`: per label the `_need` rows (columns `_label`,
    `_need` of the label-sized `need`) with the lowest hash, ties by key.

    Exact without sorting a label: a (label, leading hash bits) histogram finds
    the bucket in which the count is reached, and only its rows, about a
    millionth of the label's, are ranked."""
    h = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    hist = h.groupBy(F.col(label).alias("_label"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_label").orderBy("_b"))
    wanted = need.select(F.col("_label").alias("_nl"), "_need")
    cut = (hist.withColumn("_upto", upto).join(wanted, F.col("_label").eqNullSafe(F.col("_nl")))
               .filter(F.col("_upto") >= F.col("_need"))
               .groupBy("_label").agg(F.min_by(F.struct("_b", (F.col("_need") - F.col("_upto") + F.col("_c")).alias("left")),
                                               "_b").alias("_cut")))
    j = h.join(cut, h[label].eqNullSafe(cut["_label"]), "left").drop("_label")
    in_cut = F.coalesce(F.col("_b") == F.col("_cut._b"), F.lit(False))
    # a label without a cut bucket needs more rows than it has, or is not wanted at all
    known = wanted.withColumn("_known", F.lit(True))
    outside = (j.filter(~in_cut).join(known, F.col(label).eqNullSafe(F.col("_nl")), "left")
                .withColumn("_take", F.coalesce(F.col("_b") < F.col("_cut._b"), F.col("_known"), F.lit(False)))
                .drop("_nl", "_need", "_known"))
    rn = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    inside = j.filter(in_cut).withColumn("_take", rn <= F.col("_cut.left"))
    return outside.unionByName(inside).drop("_b", "_cut")


def stratified_sample(df: DataFrame, label: str, key: str, alloc: DataFrame, seed: int = 42) -> DataFrame:
    """alloc[label] rows per label, lowest seeded hash (column `_h`) first;
    `alloc` is one row per label (`label`, `alloc`)."""
    need = alloc.select(F.col("label").alias("_label"), F.col("alloc").alias("_need"))
    return _lowest(df, label, key, need, seed).filter("_take").drop("_take")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` in {'train','test'}: per label the round(test_share*n)
    rows with the lowest seeded hash go to test."""
    need = df.groupBy(F.col(label).alias("_label")).agg(
        F.floor(F.lit(test_share) * F.count(F.lit(1)) + 0.5).cast("long").alias("_need"))
    return (_lowest(df, label, key, need, seed)
            .withColumn("split", F.when(F.col("_take"), "test").otherwise("train")).drop("_h", "_take"))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """Mode of the label; the smallest label wins a tie. One row."""
    return (df.groupBy(F.col(label).alias("majority")).agg(F.count(F.lit(1)).alias("support"))
              .orderBy(F.desc("support"), F.asc("majority")).limit(1))
