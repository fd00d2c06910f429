"""Profiling aggregates. Each is one aggregation pass (partial aggregation on
the map side); exact percentiles by default, `approx=True` for very large
inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.text import strip_ws, word_count


def _median(c, approx: bool):
    return F.percentile_approx(c, 0.5, 10000) if approx else F.percentile(c, 0.5)


def exact_percentiles(df: DataFrame, c: str | Column, ps: dict[str, float], direct: int = 100_000, splits: int = 63) -> DataFrame:
    """Exact linear-interpolation percentiles (the `percentile` /
    `quantile_cont` definition), one row, one column per name.

    At most `direct` distinct values are counted and looked up on the driver.
    Beyond that each wanted rank is selected by refinement: approximate
    quantiles of its range (mergeable sketches) split it, exact counts a
    part tell which part holds the rank, and that part is split again until it
    has few distinct values. No task and no driver ever holds more than
    `direct` values, and a value that fills a part alone ends its search."""
    x = F.col(c) if isinstance(c, str) else c
    vals = df.select(x.cast("double").alias("v")).filter(F.col("v").isNotNull())

    def counted(rows: DataFrame) -> list[tuple[float, int]] | None:
        """(value, rows) in order, or none if there are too many."""
        got = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(direct + 1).collect()
        return None if len(got) > direct else sorted(((r["v"], r["n"]) for r in got), key=lambda t: (t[0] != t[0], t[0]))

    def at(hist: list[tuple[float, int]], rank: int) -> float:
        for v, n in hist:
            if rank < n:
                return v
            rank -= n
        raise ValueError("rank beyond the values")

    whole = counted(vals)
    n = sum(k for _, k in whole) if whole is not None else vals.count()
    pos = {name: p * (n - 1) for name, p in ps.items()}
    ranks = sorted({r for x in pos.values() for r in (math.floor(x), math.ceil(x))}) if n else []
    found = {r: at(whole, r) for r in ranks} if whole is not None else {}
    # the part that holds a rank: values above `low` up to `high` (none: open), and the rows before it
    where = {r: (None, None, 0) for r in ranks if r not in found}
    while where:
        part, mine = next((p, [r for r in where if where[r] == p]) for p in where.values())
        low, high, before = part
        rows = vals
        if low is not None:
            rows = rows.filter(F.col("v") > low)
        if high is not None:
            rows = rows.filter(F.col("v") <= high)
        hist = counted(rows) if part != (None, None, 0) else None
        if hist is not None:
            found |= {r: at(hist, r - before) for r in mine}
        else:
            cut = sorted(set(rows.agg(F.percentile_approx("v", [(i + 1) / (splits + 1) for i in range(splits)], 10_000)).first()[0]))
            # odd parts hold one value, the split itself; even parts what lies between
            below = sum((F.when(F.col("v") > q, 1).otherwise(0) for q in cut), F.lit(0))
            key = below * 2 + F.when(F.col("v").isin(cut), 1).otherwise(0)
            sizes = {r["k"]: r["n"] for r in rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for r in mine:
                k, seen = 0, before
                while seen + sizes.get(k, 0) <= r:
                    seen += sizes.get(k, 0)
                    k += 1
                if k % 2:
                    found[r] = cut[k // 2]
                else:       # above the split before; up to the last value under the next one
                    top = None if k // 2 == len(cut) else float(np.nextafter(cut[k // 2], -np.inf))
                    where[r] = (cut[k // 2 - 1] if k else low, high if top is None else top, seen)
        where = {r: w for r, w in where.items() if r not in found}
    out = {name: None if not n else found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)])
           for name, x in pos.items()}
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in ps])
    return df.sparkSession.createDataFrame([tuple(out[name] for name in ps)], schema)


def _exact_median(df: DataFrame, c) -> Column:
    return exact_percentiles(df, c, {"m": 0.5}).select("m").scalar()


def turn_profile(conv: DataFrame, c: str = "turn_count", approx: bool = False) -> DataFrame:
    """Mean, median, sample std, min, max; exactly-2 and >2 counts with pct."""
    x = F.col(c)
    n = F.count(F.lit(1))
    return conv.agg(
        F.round(F.avg(x.cast("double")), 6).alias("mean"),
        F.round(_median(x.cast("double"), True) if approx else _exact_median(conv, c), 6).alias("median"),
        F.round(F.stddev_samp(x.cast("double")), 6).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.count_if(x == 2).alias("two_turn"),
        F.round(F.try_divide(F.count_if(x == 2) * 100.0, n), 6).alias("two_turn_pct"),
        F.count_if(x > 2).alias("multi_turn"),
        F.round(F.try_divide(F.count_if(x > 2) * 100.0, n), 6).alias("multi_turn_pct"))


def turn_histogram(conv: DataFrame, c: str = "turn_count", first: int = 20) -> DataFrame:
    """First `first` values in ascending order with count and pct of rows."""
    counts = conv.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))
                  .orderBy("value").limit(first))


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_missing, pct) for columns with at least one null."""
    columns = list(columns or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = agg.selectExpr("__n", f"stack({len(columns)}, {stack}) as (column_name, n_missing)")
    return (long.filter(F.col("n_missing") > 0)
                .select("column_name", "n_missing",
                        F.round(F.col("n_missing") * 100.0 / F.col("__n"), 6).alias("pct")))


def length_profile(conv: DataFrame, tweets: DataFrame) -> DataFrame:
    """Words per customer problem (mean/median over non-null), brand response
    length (count/mean/median over non-null) and tweet text length
    (mean/median/max). One pass over each input builds a histogram of lengths
    (a row per distinct length, combined map-side) that gives all figures."""
    item = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("double").alias("v"))
    both = conv.select(F.explode(F.array(item("words", word_count("customer_problem")),
                                         item("response", F.length("brand_responses")))).alias("x"))
    h = (both.unionByName(tweets.select(item("text", F.length("text")).alias("x"))).select("x.*").filter("v IS NOT NULL")
             .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    total = F.sum("n").over(Window.partitionBy("k"))
    h = h.withColumns({"upto": upto, "total": total})
    at = lambda p: F.max(F.when((F.col("upto") - F.col("n") < p) & (F.col("upto") >= p), F.col("v")))
    one = h.groupBy("k").agg(
        F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"),
        ((at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2).alias("median"))
    get = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    r = lambda k, c, name: F.round(get(k, c), 6).alias(name)
    return one.agg(r("words", "mean", "words_mean"), r("words", "median", "words_median"),
                   F.coalesce(get("response", "n"), F.lit(0)).alias("responses_nonnull"),
                   r("response", "mean", "response_len_mean"), r("response", "median", "response_len_median"),
                   r("text", "mean", "text_len_mean"), r("text", "median", "text_len_median"),
                   get("text", "max").alias("text_len_max"))


def share_inbound(tweets: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return tweets.agg(
        F.count_if(F.col("inbound")).alias("inbound"),
        F.round(F.try_divide(F.count_if(F.col("inbound")) * 100.0, n), 6).alias("inbound_pct"),
        F.count_if(~F.col("inbound")).alias("outbound"),
        F.round(F.try_divide(F.count_if(~F.col("inbound")) * 100.0, n), 6).alias("outbound_pct"))


def top_values(df: DataFrame, c: str, k: int, out: str = "n") -> DataFrame:
    """Most frequent values; ties by value. The count is a partial
    aggregation; the top-k is a TakeOrderedAndProject (no global sort)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(c)).limit(k)


def top_words(df: DataFrame, c: str, k: int = 20) -> DataFrame:
    """Lower-case whitespace tokens over whole texts; top k by count."""
    s = strip_ws(F.lower(F.col(c)))
    words = df.select(F.explode(F.split(s, r"\s+")).alias("word")).filter(F.col("word") != "")
    return top_values(words, "word", k)


def label_distribution(df: DataFrame, c: str = "intent") -> DataFrame:
    counts = df.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def label_examples(df: DataFrame, label: str, key: str, text: str, per_label: int = 3,
                   top_labels: int = 12, width: int = 100) -> DataFrame:
    """`per_label` rows (lowest key first) for each of the `top_labels` most
    common labels, text cut to `width` characters. The per-label limit is a
    literal so Spark applies it before the shuffle (WindowGroupLimit)."""
    top = top_values(df, label, top_labels).select(label)
    w = Window.partitionBy(label).orderBy(F.col(key))
    ranked = df.select(label, key, F.substring(F.col(text), 1, width).alias("example")) \
               .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_label)
    return ranked.join(F.broadcast(top), label, "left_semi")


def kb_statistics(cases: DataFrame) -> DataFrame:
    """(intent, resolution_quality, level, n, mean_turns): by both, by each and
    in all from one aggregation; `level` tells which columns are totals."""
    both = cases.groupingSets([["intent", "resolution_quality"], ["intent"], ["resolution_quality"], []], "intent", "resolution_quality")
    return both.agg((F.grouping("intent").cast("long") + 2 * F.grouping("resolution_quality").cast("long")).alias("level"),
                    F.count(F.lit(1)).alias("n"), F.avg("turn_count").alias("mean_turns"))


def profile_state(df: DataFrame, by: str, text: str) -> DataFrame:
    """A mergeable profile of one part of a table: counts, text lengths and a
    sketch of the distinct texts. A new part needs no rescan of the old ones."""
    n = F.length(text)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"),
                              F.hll_sketch_agg(text).alias("sketch"))


def merge_profiles(states: DataFrame, by: str) -> DataFrame:
    """Profiles of disjoint parts as one; `distinct` is the sketch's estimate."""
    return states.groupBy(by).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("shortest").cast("long").alias("shortest"),
                                  F.max("longest").cast("long").alias("longest"),
                                  F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
