"""TF-IDF + logistic regression intent/label baseline (Spark ML).

The featuriser follows the classifier settings (uni+bigrams, English stop
words, min_df=2, max_df=0.95, 10,000 features); class weights are balanced
(n / (k * n_class)) through `weightCol`, and the L2 strength maps the C=1
convention to Spark's per-row loss scaling (regParam = 1 / (C * n)).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, NGram, Normalizer, RegexTokenizer,
                                SQLTransformer, StopWordsRemover, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.operators.tfidf import TOKEN, english_stop_words
from ticketlake.session import write_and_read


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (k * n_class) per row; the class counts are a label-sized table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = F.sum("_nc").over(Window.partitionBy())
    k = F.count(F.lit(1)).over(Window.partitionBy())
    w = counts.select(label, (tot / (k * F.col("_nc"))).alias(out))
    # by a shuffle on the label a class would be one task of every later pass
    return df.join(F.broadcast(w), label)


def fit_logreg(train: DataFrame, text: str, label: str, C: float = 1.0, max_iter: int = 1000,
               vocab_size: int = 10000) -> PipelineModel:
    """Featuriser and classifier as one model. The weights are tf * idf with
    idf = ln((1+n)/(1+df)) + 1, as in `tfidf.fit_vocabulary`: Spark's IDF lacks
    the + 1, so its vector (at most `vocab_size` numbers) is raised by it.

    The texts are read twice, for the vocabulary and for the counts of its terms;
    the counts are written, and all later passes read them."""
    n = train.count()
    most = 0.95 * n         # as a number: for a share all terms of all texts would be kept at once
    counts = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_uni", stopWords=list(english_stop_words()), caseSensitive=True),
        NGram(n=2, inputCol="_uni", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_uni, _bi) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocab_size, minDF=2.0,
                        maxDF=most if most >= 1.0 else 0.95),
    ]).fit(train)
    tf = write_and_read(counts.transform(train).select(label, "_tf"), "term-counts")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).idf.toArray() + 1.0
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    classify = Pipeline(stages=[
        weigh, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="label_idx", weightCol="weight", maxIter=max_iter,
                           regParam=1.0 / (C * max(1, n)), elasticNetParam=0.0, standardization=False,
                           family="multinomial"),
    ]).fit(balanced_weights(tf, label))
    return PipelineModel([counts, *classify.stages])


def predict_labels(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Adds `pred` in the original label space and `probabilities`, a map from
    label to class probability."""
    indexer = next(s for s in model.stages if s.hasParam("stringOrderType"))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    out = model.transform(df.withColumn("weight", F.lit(1.0)))
    p = vector_to_array("probability")
    return (out.withColumn("pred", F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")))
               .withColumn("probabilities", F.map_from_arrays(names, p)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
