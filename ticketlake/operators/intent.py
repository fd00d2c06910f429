"""Intent labelling, result coercion and prediction cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake import lexicons as L
from ticketlake.operators.sampling import seeded_hash
from ticketlake.functions.text import best_label, col, keyword_scores, lower_text, strip_ws


def keyword_label(c: str | Column, lexicon=L.TAXONOMY_KEYWORDS, default: str = L.DEFAULT_INTENT) -> Column:
    """Most keyword hits wins (substring match); ties -> earlier intent in
    lexicon order; null text or no hit -> default."""
    label, _ = best_label(keyword_scores(lower_text(c), lexicon), default)
    return F.when(col(c).isNull(), F.lit(default)).otherwise(label)


def map_labels(c: str | Column, mapping: dict[str, str] = L.LABEL_MAP) -> Column:
    out = col(c)
    for src, dst in mapping.items():
        out = F.when(out == src, F.lit(dst)).otherwise(out)
    return out


def classify_with_confidence(c: str | Column, lexicon=L.CLASSIFIER_KEYWORDS,
                             default: str = L.DEFAULT_INTENT, lowered: Column | None = None) -> Column:
    """struct(intent, confidence, reasoning): confidence min(cap, base+step*hits);
    blank / null / no hit -> (default, 0.3)."""
    text = col(c)
    low = lowered if lowered is not None else lower_text(text)
    label, best = best_label(keyword_scores(low, lexicon), default)
    blank = text.isNull() | (strip_ws(text) == "")
    conf = F.least(F.lit(L.CONF_CAP), F.lit(L.CONF_BASE) + best.cast("double") * F.lit(L.CONF_STEP))
    return (F.when(blank, F.struct(F.lit(default).alias("intent"), F.lit(L.CONF_NONE).alias("confidence"),
                                   F.lit("Empty or invalid message").alias("reasoning")))
            .when(best > 0, F.struct(label.alias("intent"), conf.alias("confidence"),
                                     F.lit("Keyword match").alias("reasoning")))
            .otherwise(F.struct(F.lit(default).alias("intent"), F.lit(L.CONF_NONE).alias("confidence"),
                                F.lit("No keyword match").alias("reasoning"))))


def label_table(df: DataFrame, text_col: str = "customer_problem", out: str = "intent",
                lexicon=L.TAXONOMY_KEYWORDS, default: str = L.DEFAULT_INTENT) -> DataFrame:
    """Adds the keyword label. The (score, position, label) winner is its own
    projection, so the keyword tests are generated once."""
    scores = keyword_scores(F.col("_low"), lexicon)
    top = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("p"), F.lit(name).alias("l"))
                                for i, (name, s) in enumerate(scores)]))
    return (df.withColumn("_low", lower_text(text_col)).withColumn("_top", top).drop("_low")
              .withColumn(out, F.when(col(text_col).isNull() | (F.col("_top.s") <= 0), F.lit(default))
                                .otherwise(F.col("_top.l")))
              .drop("_top"))


def classify_table(df: DataFrame, text_col: str = "message", lexicon=L.CLASSIFIER_KEYWORDS) -> DataFrame:
    """Adds intent / confidence / reasoning; the result struct is computed
    once in its own projection and then unpacked."""
    r = classify_with_confidence(text_col, lexicon, lowered=F.col("_low"))
    return (df.withColumn("_low", lower_text(text_col)).withColumn("_cls", r).drop("_low")
              .withColumns({"intent": F.col("_cls.intent"), "confidence": F.col("_cls.confidence"),
                            "reasoning": F.col("_cls.reasoning")}).drop("_cls"))


# ------------------------------------------------------------ F8-F10 coercion

CLASSIFICATION_SCHEMA = T.StructType([
    T.StructField("intent", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("reasoning", T.StringType())])
ROUTING_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("risk_score", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("confidence", T.StringType()), T.StructField("has_evidence", T.BooleanType())])
GENERATION_SCHEMA = T.StructType([
    T.StructField("response", T.StringType()),
    T.StructField("evidence_case_ids", T.ArrayType(T.StringType())),
    T.StructField("escalate", T.BooleanType()), T.StructField("reason", T.StringType())])


def number(c: Column) -> Column:
    """DOUBLE from a number or numeric text; null otherwise."""
    return F.trim(c.cast("string")).try_cast("double")


def coerce_classification(parsed: Column, valid: Sequence[str] = L.VALID_INTENTS) -> Column:
    """Unknown intent -> general_inquiry; confidence (a number, or a string
    that is one) default 0.3; reasoning default ''; `error` names a confidence
    that is out of range or no number instead of raising."""
    intent = F.when(parsed["intent"].isin(*valid), parsed["intent"]).otherwise(F.lit(L.DEFAULT_INTENT))
    conf = F.coalesce(number(parsed["confidence"]), F.lit(L.CONF_NONE))
    err = (F.when((conf < 0) | (conf > 1), F.lit("confidence out of range"))
           .when(parsed["confidence"].isNotNull() & number(parsed["confidence"]).isNull(), F.lit("confidence is not a number")))
    return F.struct(intent.alias("intent"), conf.alias("confidence"),
                    F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"), err.alias("error"))


def coerce_routing(parsed: Column) -> Column:
    action = F.when(parsed["action"].isin(*L.VALID_ACTIONS), parsed["action"]).otherwise(F.lit("auto_handle"))
    return F.struct(action.alias("action"),
                    F.coalesce(number(parsed["risk_score"]), F.lit(0.0)).alias("risk_score"),
                    F.coalesce(parsed["reason"], F.lit("")).alias("reason"),
                    F.coalesce(parsed["intent"], F.lit("")).alias("intent"),
                    F.coalesce(number(parsed["confidence"]), F.lit(0.0)).alias("confidence"),
                    F.coalesce(parsed["has_evidence"], F.lit(False)).alias("has_evidence"))


def coerce_generation(parsed: Column) -> Column:
    return F.struct(F.coalesce(parsed["response"], F.lit("")).alias("response"),
                    F.coalesce(parsed["evidence_case_ids"], F.array().cast("array<string>")).alias("evidence_case_ids"),
                    F.coalesce(parsed["escalate"], F.lit(False)).alias("escalate"),
                    F.coalesce(parsed["reason"], F.lit("")).alias("reason"))


# ------------------------------------------------------------ F11 cascade

def cascade(base: DataFrame, key: str, providers: Sequence[tuple[str, DataFrame]],
            fallback_provider: str, fallback: dict[str, Column]) -> DataFrame:
    """First provider with a row for the key wins; the fallback columns are
    used otherwise. Provider tables hold (key, intent, confidence, reasoning)
    and are left-joined on the key (each join shuffles on the key, no skew
    beyond one row per key per provider)."""
    out = base
    fields = list(fallback.keys())
    for i, (_, pdf) in enumerate(providers):
        out = out.join(pdf.select(key, *[F.col(f).alias(f"{f}__{i}") for f in fields],
                                  F.lit(True).alias(f"hit__{i}")), key, "left")
    provider = F.lit(fallback_provider)
    for i, (name, _) in reversed(list(enumerate(providers))):
        provider = F.when(F.col(f"hit__{i}"), F.lit(name)).otherwise(provider)
    cols = {}
    for f in fields:
        v = fallback[f]
        for i in reversed(range(len(providers))):
            v = F.when(F.col(f"hit__{i}"), F.col(f"{f}__{i}")).otherwise(v)
        cols[f] = v
    cols["provider"] = provider
    drop = [c for c in out.columns if "__" in c]
    return out.withColumns(cols).drop(*drop)


def taxonomy_frame(spark, confusions=L.TAXONOMY_CONFUSIONS, definitions=L.TAXONOMY_DEFINITIONS,
                   examples: dict[str, list[str]] | None = None, store: str = "store") -> DataFrame:
    """(intent, definition, examples, confusing_with), a row per intent."""
    rows = [(k, definitions.get(k, "").format(store=store), (examples or {}).get(k, []), v) for k, v in confusions.items()]
    return spark.createDataFrame(rows, "intent string, definition string, examples array<string>, confusing_with array<string>")


def label_examples(labelled: DataFrame, n: int = 3, key: str = "conversation_id", text: str = "customer_problem",
                   label: str = "intent", seed: int = 42) -> DataFrame:
    """(label, examples): up to `n` texts per label, lowest seeded hash first;
    the literal limit lets Spark cut every label before the shuffle."""
    w = Window.partitionBy(label).orderBy("_h", key)
    top = (labelled.withColumn("_h", seeded_hash(key, seed)).withColumn("_rn", F.row_number().over(w))
                   .filter(F.col("_rn") <= n))
    return top.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text))), lambda x: x[text]).alias("examples"))
