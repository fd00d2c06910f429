"""Classification, agreement and ranking metrics as grouped aggregations over
a prediction table (group columns, truth, prediction). Per-label tables are
label-sized; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake import lexicons as L


def per_label(pred: DataFrame, truth: str = "truth", predicted: str = "pred",
              group: Sequence[str] = ("model",)) -> DataFrame:
    """(group..., label, tp, support, n_pred, precision, recall, f1) over the
    union of true and predicted labels; undefined ratios are 0."""
    g = list(group)
    t = pred.groupBy(*g, F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp"))
    p = pred.groupBy(*g, F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = t.join(p, [*g, "label"], "full_outer").fillna(0, ["support", "tp", "n_pred"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f1", f1)


def summary(per: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """(group..., accuracy, macro_f1, weighted_f1, n)."""
    g = list(group)
    return per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")),
                   F.lit(0.0)).alias("weighted_f1"),
        F.sum("support").alias("n"))


def classification_report(pred: DataFrame, truth: str = "truth", predicted: str = "pred",
                          group: Sequence[str] = ("model",)) -> DataFrame:
    """Per-label rows plus 'accuracy', 'macro avg' and 'weighted avg' rows."""
    g = list(group)
    per = per_label(pred, truth, predicted, g)
    r6 = lambda c: F.round(c, 6)
    labels = per.select(*g, "label", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                        r6(F.col("f1")).alias("f1"), F.col("support").cast("long").alias("support"))
    agg = per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf"), F.sum("support").alias("n"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = [("accuracy", "acc", "acc", "acc"), ("macro avg", "mp", "mr", "mf"), ("weighted avg", "wp", "wr", "wf")]
    extra = [agg.select(*g, F.lit(name).alias("label"), r6(F.col(p)).alias("precision"), r6(F.col(r)).alias("recall"),
                        r6(F.col(f)).alias("f1"), F.col("n").cast("long").alias("support"))
             for name, p, r, f in rows]
    out = labels
    for e in extra:
        out = out.unionByName(e)
    return out


def confusion_matrix(pred: DataFrame, labels: Sequence[str], truth: str = "truth", predicted: str = "pred") -> DataFrame:
    """One row per label in `labels` (fixed order kept by `label_pos`), one
    count column per predicted label; empty rows stay."""
    cells = pred.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(labels)).count()
    spark = pred.sparkSession
    frame = spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "truth string, label_pos int")
    out = frame.join(cells, "truth", "left")
    return out.select("truth", "label_pos", *[F.coalesce(F.col(f"`{l}`"), F.lit(0)).cast("long").alias(f"pred_{l}")
                                               for l in labels])


def agreement(pred: DataFrame, truth: str = "truth", predicted: str = "pred",
              positive: str = "escalate", negative: str = "auto_handle") -> DataFrame:
    """accuracy, Cohen's kappa (null when chance agreement is 1) and the
    false auto-handle rate (positive truth predicted negative / positive
    truth; 0 when there is none)."""
    t = pred.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("nt"))
    p = pred.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("np"))
    marg = t.join(p, "label", "full_outer").fillna(0)
    tot = pred.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.col(truth) == F.col(predicted)).alias("agree"),
                   F.count_if((F.col(truth) == positive) & (F.col(predicted) == negative)).alias("false_auto"),
                   F.count_if(F.col(truth) == positive).alias("pos"))
    pe = marg.agg(F.sum(F.col("nt").cast("double") * F.col("np").cast("double")).alias("pe_num"))
    # both are single-row aggregates: attach pe as a scalar subquery
    j = tot.select("*", pe.select("pe_num").scalar().alias("pe_num"))
    po = F.col("agree") / F.col("n")
    pe_ = F.col("pe_num") / (F.col("n").cast("double") * F.col("n").cast("double"))
    kappa = F.when(pe_ == 1.0, F.lit(None).cast("double")).otherwise((po - pe_) / (F.lit(1.0) - pe_))
    far = F.coalesce(F.try_divide(F.col("false_auto").cast("double"), F.col("pos").cast("double")), F.lit(0.0))
    return j.select(F.col("n"), F.round(po, 6).alias("accuracy"), F.round(kappa, 6).alias("kappa"),
                    F.col("false_auto"), F.col("pos").alias("n_escalate_truth"), F.round(far, 6).alias("false_auto_rate"))


def routing_cells(pred: DataFrame, truth: str = "t", predicted: str = "p", positive: str = "escalate", negative: str = "auto_handle") -> DataFrame:
    """One row: n, accuracy, the four cells of truth and prediction, and the
    false auto-handle rate (0 without a positive truth)."""
    cell = lambda a, b: F.count_if((F.col(truth) == a) & (F.col(predicted) == b))
    pos = F.count_if(F.col(truth) == positive)
    rate = F.coalesce(F.try_divide(cell(positive, negative).cast("double"), pos.cast("double")), F.lit(0.0))
    return pred.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)), 6).alias("accuracy"),
                    cell(negative, negative).alias("auto_auto"), cell(negative, positive).alias("auto_escalate"),
                    cell(positive, negative).alias("escalate_auto"), cell(positive, positive).alias("escalate_escalate"),
                    F.round(rate, 6).alias("false_auto_rate"))


def with_external(preds: DataFrame, messages: DataFrame, external: dict[str, DataFrame], default: str, key: str = "message_id") -> DataFrame:
    """Adds tables of predictions (key, pred) made elsewhere to (model, truth,
    pred); a message without a prediction has the default, of several
    predictions for one the first by name counts."""
    out = preds.select("model", "truth", "pred")
    for name, table in external.items():
        one = table.groupBy(key).agg(F.min("pred").alias("pred"))
        out = out.unionByName(messages.join(one, key, "left").select(
            F.lit(name).alias("model"), "truth", F.coalesce("pred", F.lit(default)).alias("pred")))
    return out


def recall_at(ranked: DataFrame, queries: DataFrame, key: str = "query_id", truth: str = "truth",
              case_intent: str = "intent", rank: str = "rerank_rank", ks=(1, 3, 5)) -> DataFrame:
    """Rank of the first case with the query's intent; recall@k and MRR over
    all queries (a query without a hit counts as a miss)."""
    first = (ranked.filter(F.col(case_intent) == F.col(truth))
                   .groupBy(key).agg(F.min(rank).alias("hit_rank")))
    j = queries.select(key).join(first, key, "left")
    aggs = [F.round(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    return j.agg(F.count(F.lit(1)).alias("n_queries"), *aggs,
                 F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


JUDGE_SCHEMA = T.StructType([T.StructField(d, T.DoubleType()) for d in L.JUDGE_DIMENSIONS])


def judge_scores(raw: DataFrame, json_col: str, group: Sequence[str]) -> DataFrame:
    """Mean per dimension (missing score -> 3) and number judged, per group;
    unparseable JSON rows are not judged."""
    parsed = raw.withColumn("_j", F.from_json(F.col(json_col), JUDGE_SCHEMA))
    ok = parsed.filter(F.col("_j").isNotNull())
    aggs = [F.round(F.avg(F.coalesce(F.col(f"_j.{d}"), F.lit(L.JUDGE_MISSING))), 6).alias(d) for d in L.JUDGE_DIMENSIONS]
    return ok.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("n_judged"))
