"""Mixing sources to target weights, in DataFrame functions only.

Token shares p of the sources are raised to an exponent a, w = p^a / sum(p^a).
The exponent is found by bisection (31 inner points a round, each a grouped
expression over the table of sources): the largest flattening whose most
repeated source stays within `max_repeats`, or the exponent whose weights have
entropy `entropy` (in nats). The weights are realised as budgeted block
permutations: a source passes its documents in a new hash permutation as often
as weight x budget demands, the last pass as far as the budget reaches, and the
k-th share of its tokens belongs to the k-th block, so each block of
`block_tokens` tokens holds every source by its weight; inside a block the
order is another hash permutation.

Without `budget` it is the least at which every document is used at least once.

Scale: positions are prefix sums. A pass is cut into hash ranges of about
`range_rows` documents; sums of ranges are prefixed over the (small) table of
ranges and the documents inside their range only, so a hot source is split.
The windows are bounded by a range, a block, or the number of ranges of a pass.

Defined cases: a null text has no tokens; a null source is a source of its
own; a source without tokens has weight zero and passes its documents once, each
in a block that its hash draws; null and repeated ids are rows like any other
(rows equal in source, id and length are numbered and draw by their number, so
that copies spread over the ranges and blocks); one source gives weight 1; very long texts only
count their words; an empty table gives an empty result. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import WORD, col, written


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bisect(sources: DataFrame, value, target: float, low: float, high: float, points: int = 31,
            rounds: int = 7) -> float:
    """The exponent in [low, high] at which `value` (falling in the exponent)
    comes down to `target`; `value(a)` is an aggregate over the sources."""
    for _ in range(rounds):
        at = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
        got = sources.agg(*[value(a).alias(f"v{i}") for i, a in enumerate(at)]).first()
        above = sum(1 for v in got if v is not None and v > target)     # falling: these come first
        low, high = (at[above - 1] if above else low), (at[above] if above < points else high)
    return (low + high) / 2


def exponent(sources: DataFrame, *, max_repeats: float | None = None, entropy: float | None = None,
             budget: float | None = None) -> float:
    """The exponent for sources (tokens > 0), to 6 decimals."""
    top = sources.agg(F.max("tokens").alias("m"), F.sum("tokens").alias("t")).first()
    if top["m"] is None:
        return 1.0
    logp = F.log(F.col("tokens") / float(top["t"]))
    if entropy is not None:
        def h(a: float) -> Column:
            z = F.sum(F.exp(logp * a))
            return F.log(z) - a * F.sum(F.exp(logp * a) * logp) / z
        return round(_bisect(sources, h, entropy, 0.0, 8.0), 6)

    def repeats(a: float) -> Column:
        # a source is used budget * w / tokens times; the default budget uses the largest source once
        if budget is None:
            return F.max(F.exp((a - 1) * F.log(F.col("tokens") / float(top["m"]))))
        return F.max(F.exp(logp * a) / F.col("tokens")) * float(budget) / F.sum(F.exp(logp * a))
    return round(_bisect(sources, repeats, max_repeats or 1.0, 0.0, 1.0), 6)


def weights(sources: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, repeats) at exponent `a`; the table of sources
    is aggregated to one row of totals that joins back as constants."""
    pos = sources.where("tokens > 0")
    tot = pos.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m"),
                  F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z")).first()
    if tot["t"] is None:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"))
    w = F.round(F.pow(F.col("tokens").cast("double"), F.lit(a)) / float(tot["z"]), 12)
    if budget is None:
        rep = F.pow(float(tot["m"]) / F.col("tokens"), F.lit(1 - a)) if a <= 1 else \
            F.pow(F.col("tokens") / F.lit(float(_least(pos))), F.lit(a - 1))
    else:
        rep = w * float(budget) / F.col("tokens")
    return sources.select("source", "tokens", F.when(F.col("tokens") > 0, w).otherwise(0.0).alias("weight"),
                          F.when(F.col("tokens") > 0, F.round(rep, 9)).otherwise(1.0).alias("repeats"))


def _least(pos: DataFrame) -> int:
    return pos.agg(F.min("tokens")).first()[0]


def _draw(*parts: Column, tie: Column) -> Column:
    """A pseudo-random 32-hex-digit string of the parts, and of `tie` unless it is null."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], tie.cast("string")))


def _with_ties(t: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Adds `tie`: rows equal in source, id and length are numbered from 0 (it
    does not matter which is which), other rows have none. Equal rows are
    counted before they are shuffled, and given out again by chunks."""
    key = ["source", "id", "n_tokens"]
    n = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n = written(n, "repeats")
    many = n.where("n > 1").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    tie = F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk) - 1)
    many = many.repartition(*key, "c").select(*key, F.explode(tie).alias("tie"))
    return n.where("n = 1").select(*key, F.lit(None).cast("long").alias("tie")).unionByName(many)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_repeats: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
        block_tokens: int = 1_000_000, range_rows: int = 2_500, seed: int = 17) -> DataFrame:
    """(id, source, n_tokens, pass, block, position): the mixture, a row for
    every use of a document; `position` counts from 1 inside the block."""
    t = written(docs.select(col(id_col).alias("id"), col(source_col).alias("source"),
                            token_count(col(text_col)).alias("n_tokens")), "tokens")
    sources = written(t.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    a = exponent(sources.where("tokens > 0"), max_repeats=max_repeats, entropy=entropy, budget=budget)
    w = written(_with_counts(weights(sources, a, budget), sources), "weights")
    total = w.agg(F.sum(F.col("repeats") * F.col("tokens")).alias("b")).first()["b"] or 0.0
    n_blocks = max(1, math.ceil(total / block_tokens))

    s, tie = F.lit(seed), F.col("tie")
    used = (_with_ties(t).join(w.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("repeats").cast("int") - 1))))
             .withColumn("draw", _draw(s, F.col("pass"), F.col("id"), F.col("n_tokens"), tie=tie))
             .withColumn("ranges", F.ceil(F.col("n_docs") / range_rows))
             .withColumn("range", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") * F.col("ranges")
                                          / 4294967296.0))
             .select("id", "source", "n_tokens", "tie", "tokens", "repeats", "pass", "draw", "range"))
    by = ["source", "pass"]
    sums = used.groupBy(*by, "range").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(
        Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("range").alias("_r"),
                           F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "range").orderBy("draw", "id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (used.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
                  .join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p"))
                        & (F.col("range") == F.col("_r")))
                  .withColumn("at", F.col("_before") + F.col("_in") + F.col("pass") * F.col("tokens")))
    # the last pass goes as far as the budget: a document is used if it begins before the end
    placed = placed.where((F.col("pass") == 0) & (F.col("repeats") >= 1) | (F.col("at") < F.col("repeats") * F.col("tokens")))
    drawn = F.conv(F.substring("draw", 9, 8), 16, 10).cast("double") / 4294967296.0
    share = F.when(F.col("tokens") > 0, F.col("at") / (F.col("repeats") * F.col("tokens"))).otherwise(drawn)
    placed = placed.withColumn("block", F.least(F.floor(share * n_blocks), F.lit(n_blocks - 1)).cast("long"))
    order = Window.partitionBy("block").orderBy(_draw(s, F.lit("block"), F.col("block"), F.col("pass"), F.col("id"),
                                                      F.col("n_tokens"), tie=tie), "source", "pass", "id", "n_tokens")
    return placed.withColumn("position", F.row_number().over(order)).select(
        "id", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), "block", F.col("position").cast("long").alias("position"))


def _with_counts(w: DataFrame, sources: DataFrame) -> DataFrame:
    n = sources.select(F.col("source").alias("_s"), "n_docs")
    return w.join(n, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
