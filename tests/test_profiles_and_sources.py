"""Order statistics by refinement, split CSV scans, lexicons of any size."""
import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake import lexicons as L
from ticketlake.functions.lexicon import label_by_lexicon, lexicon_table
from ticketlake.operators import intent as I
from ticketlake.operators import models as MD
from ticketlake.operators import sampling as SM
from ticketlake.operators.profile import exact_percentiles
from ticketlake.sources import split_csv
from ticketlake.sources import tables as S

PS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0, "f": 0.333, "g": 0.9999}


@pytest.mark.parametrize("kind", ["uniform", "skewed", "wide", "one value", "heavy value", "few"])
def test_percentiles_by_refinement_match_numpy(spark, kind):
    r = np.random.default_rng(3)
    n = 20_000
    vals = {"uniform": r.random(n), "skewed": r.exponential(size=n) ** 6, "wide": 10.0 ** r.uniform(-250, 250, n) * r.choice([-1, 1], n),
            "one value": np.full(n, 2.5), "heavy value": np.where(r.random(n) < 0.6, 1.0, r.random(n) * 2),
            "few": r.random(3)}[kind]
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double").repartition(4)
    got = exact_percentiles(df, "x", PS, direct=300, splits=15).first()
    for name, p in PS.items():
        assert got[name] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-9, abs=1e-300)


def test_a_million_distinct_doubles(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003 / 3.0).alias("x"))
    got = exact_percentiles(df, "x", PS).first()
    vals = np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003 / 3.0
    assert all(got[k] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-9) for k, p in PS.items())
    assert exact_percentiles(df.where("x < -1"), "x", PS).first().a is None


def test_split_csv_equals_the_multi_line_reader(spark, tmp_path):
    r = random.Random(2)
    bits = ["plain", "two\nlines", 'say ""x""'.replace('""', '"'), "a,b", "", "\n\n", '"', "three\n\"quoted\"\n, lines", "é 🙂", "x" * 300]
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    for f in range(2):
        with open(tmp_path / f"part{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator="\n")
            w.writerow(["i", "a", "b"])
            for i in range(400):
                w.writerow([f * 1000 + i, r.choice(bits) + r.choice(bits), r.choice(bits)])
    (tmp_path / "part9.csv").write_text("")
    key = lambda df: sorted((x.i, x.a or "", x.b or "") for x in df.collect())
    want = key(S.read_csv(spark, str(tmp_path), schema))
    assert len(want) == 800
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", "1000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = split_csv.read_split_csv(spark, str(tmp_path), schema)
            assert key(got) == want
            if size == "200":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("lexicon", [L.TAXONOMY_KEYWORDS, L.CLASSIFIER_KEYWORDS, L.BASELINE_KEYWORDS])
def test_lexicon_tables_label_like_the_expressions(spark, lexicon):
    words = [k for kws in lexicon.values() for k in kws]
    r = random.Random(4)
    rows = [(" ".join(r.choices(words + ["xx", "Parcel", "IS"], k=r.randint(0, 6))).title(),) for _ in range(300)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    table = lexicon_table(spark, lexicon)
    got = df.select(I.keyword_label("t", lexicon).alias("want"), label_by_lexicon(F.col("t"), table, L.DEFAULT_INTENT)["label"].alias("got")).collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_lexicon_of_fifty_thousand_keywords(spark):
    big = {f"label{i}": [f"key{i}x{j}z" for j in range(500)] for i in range(100)}
    table = lexicon_table(spark, big)
    df = spark.createDataFrame([(f"aa key{i}x{i}z key{i}x{i + 1}z key{i + 1}x3z", f"label{i}") for i in range(90)], "t string, want string")
    out = df.select("want", label_by_lexicon(F.col("t"), table, "none").alias("x")).collect()
    assert all(x.x.label == x.want and x.x.hits == 2 for x in out)
    with pytest.raises(ValueError):
        label_by_lexicon(F.col("t"), table, "none", max_keywords=10)
    none = df.select(label_by_lexicon(F.col("t"), table.where("false"), "none").alias("x")).first()
    assert none.x.label == "none"


def test_classifier_is_at_its_optimum(spark):
    """The gradient of the regularised, class-weighted loss vanishes at the
    fitted weights, recomputed in numpy; predictions beat the majority."""
    r = random.Random(9)
    topics = {"a": ["refund", "money", "card"], "b": ["parcel", "late", "courier"], "c": ["login", "password", "reset"]}
    rows = []
    for i in range(180):
        y = "a" if i % 2 else r.choice("bc")
        rows.append((i, " ".join(r.choices(topics[y] + ["please", "thanks", "order"], k=8)), y))
    df = spark.createDataFrame(rows, "id long, text string, y string")
    model = MD.fit_logreg(df, "text", "y", max_iter=1000)
    lr = model.stages[-1]
    got = model.transform(MD.balanced_weights(df, "y")).select("features", "label_idx", "weight").collect()
    x = np.array([g.features.toArray() for g in got])
    y = np.array([int(g.label_idx) for g in got])
    w = np.array([g.weight for g in got])
    coef, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    z = x @ coef.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    d = w[:, None] * (p - np.eye(3)[y]) / w.sum()
    grad = np.concatenate(((d.T @ x + lr.getOrDefault("regParam") * coef).ravel(), d.sum(0)))
    assert np.linalg.norm(grad) < 1e-4 < np.linalg.norm(d.T @ x)
    assert (p.argmax(1) == y).mean() > 0.9 > np.bincount(y).max() / len(y)


def test_exact_allocation_adds_up(spark):
    rows = [(k, i) for k, n in {"a": 70, "b": 20, "c": 7, "d": 2, None: 1}.items() for i in range(n)]
    df = spark.createDataFrame(rows, "label string, i long")
    for n in (0, 3, 12, 40, 99, 100, 500):
        got = SM.exact_allocation(df, "label", n, minimum=2).collect()
        assert all(x.alloc <= x.n_rows for x in got)
        low = sum(min(2, x.n_rows) for x in got)
        assert sum(x.alloc for x in got) == max(min(n, 100), low)
