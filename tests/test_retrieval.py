"""Retrieval over postings, pruned top-k, the text encoder, and vectors' edge cases."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import encoder as E
from ticketlake.operators import postings as B
from ticketlake.operators import pruned_topk as PT
from ticketlake.operators import vectors as V


def plain_search(queries, corpus, k, min_score=0.01, exclude_self=False, parts=None):
    """All pairs, in plain Python: rows of (qid, cid, rank)."""
    def terms(t):
        tok = re.findall(r"[^\W]{2,}", (t or "").lower())
        return Counter(tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])])
    docs = [(i, terms(t)) for i, t in corpus]
    df = Counter(w for _, t in docs for w in t)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(t):
        v = {w: n * idf[w] for w, n in t.items() if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()} if n else {}
    dv = [(i, unit(t)) for i, t in docs]
    out = set()
    for q, text in queries:
        qv = unit(terms(text))
        s = [(-round(sum(x * v.get(w, 0) for w, x in qv.items()), 10), i) for i, v in dv if not (exclude_self and i == q)
             and (parts is None or parts[q] == parts[i])]
        out |= {(q, i, r + 1) for r, (x, i) in enumerate(sorted(x for x in s if -x[0] >= min_score)[:k])}
    return out


def corpus_of(r, n, words=60):
    common = [f"w{i}" for i in range(words)]
    return [(i, " ".join(r.choices(common, [1 / (j + 1) for j in range(words)], k=r.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("inverted,seed_docs,salt,pays", [(False, 2000, 100_000, 8), (False, 3, 7, 0), (True, 0, 1, 1), (True, 3, 7, 0)])
def test_search_equals_all_pairs(spark, monkeypatch, inverted, seed_docs, salt, pays):
    monkeypatch.setattr(B, "SEED_DOCS", seed_docs)
    monkeypatch.setattr(B, "SALT_ROWS", salt)
    monkeypatch.setattr(B, "FORWARD_PAYS", pays)        # 0: forward rows are always read
    r = random.Random(5)
    docs = corpus_of(r, 150) + [(900, None), (901, ""), (902, "! ?")]
    queries = [(1000 + i, t) for i, (_, t) in enumerate(corpus_of(r, 12))] + [(3, docs[3][1])]
    c = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "q long, text string")
    index = B.build_index(c, "doc_id", "text", inverted=inverted)
    got = B.search(index, q, "q", "text", top_k=4, exclude_self=True, q_name="q", c_name="d").collect()
    assert {(x.q, x.d, x["rank"]) for x in got} == plain_search(queries, docs, 4, exclude_self=True)


@pytest.mark.parametrize("inverted,block_terms", [(False, 2_000_000), (False, 400), (True, 400)])
def test_blocked_search_equals_all_pairs(spark, monkeypatch, inverted, block_terms):
    """Many queries are met block by block: no row a pair is shuffled."""
    monkeypatch.setattr(B, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(B, "SCAN_PAYS", 0)
    monkeypatch.setattr(B, "_meet", None)
    r = random.Random(5)
    docs = corpus_of(r, 150) + [(900, None), (901, ""), (902, "! ?"), *((1000 + i, "w1 w2 w3") for i in range(20))]
    c = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = B.build_index(c, "doc_id", "text", inverted=inverted)
    got = B.search(index, c, "doc_id", "text", top_k=4, exclude_self=True, q_name="q", c_name="d").collect()
    assert {(x.q, x.d, x["rank"]) for x in got} == plain_search(docs, docs, 4, exclude_self=True)
    rows = [(str(i), t, [None, "a", "b"][i % 3]) for i, t in docs] + [(None, "w1 w2", "a")]
    s = spark.createDataFrame(rows, "doc_id string, text string, part string")
    got = B.tfidf_retrieve(s, "doc_id", "text", s, "doc_id", "text", top_k=3, part="part", exclude_self=True, mark_empty=True).collect()
    monkeypatch.undo()
    monkeypatch.setattr(B, "SCAN_PAYS", 1e9)
    want = B.tfidf_retrieve(s, "doc_id", "text", s, "doc_id", "text", top_k=3, part="part", exclude_self=True, mark_empty=True).collect()
    key = lambda t: sorted((str(x.query_id), str(x.doc_id), x["rank"], round(x.score, 9)) for x in t)
    assert key(got) == key(want)


@pytest.mark.parametrize("runs,run_blocks", [(1, 100), (3, 1)])
def test_pairs_of_blocks_shuffle_nothing(spark, monkeypatch, runs, run_blocks):
    """Vectors are written once a side, however many blocks there are; a run of
    the documents' blocks gives out a query's best once."""
    monkeypatch.setattr(B, "BLOCK_TERMS", 300)
    monkeypatch.setattr(B, "BLOCK_RUNS", runs)
    monkeypatch.setattr(B, "RUN_BLOCKS", run_blocks)
    docs = corpus_of(random.Random(8), 120) + [(1000 + i, "w1 w2 w3") for i in range(9)]
    c = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = B.build_index(c, "doc_id", "text", inverted=False)
    pairs = B._blocked(index, B.grams(c, "doc_id", "text"), 4, 0.01, True, False)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    if runs == 1:
        assert pairs.groupBy("qrid").count().agg(F.max("count")).first()[0] == 4
    monkeypatch.setattr(B, "SCAN_PAYS", 0)
    got = B.search(index, c, "doc_id", "text", top_k=4, exclude_self=True, q_name="q", c_name="d").collect()
    assert {(x.q, x.d, x["rank"]) for x in got} == plain_search(docs, docs, 4, exclude_self=True)


def test_many_queries_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "_meet", None)
    docs = [(i, f"the of and text number filler{i % 50} unique{i}") for i in range(600)]
    c = spark.createDataFrame(docs, "d long, t string")
    got = B.tfidf_retrieve(c, "d", "t", c, "d", "t", top_k=2, exclude_self=True).collect()
    assert len(got) == 1200 and all(x.query_id % 50 == x.doc_id % 50 for x in got)


def test_terms_are_counted_in_runs(spark, monkeypatch):
    """A task sorts a bounded number of terms at once, however many rows a batch has."""
    import pyarrow as pa
    monkeypatch.setattr(B, "COUNT_TERMS", 10)
    rows = [[5, 5, 1], [], None, list(range(30)), [2], [2, 2], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(rows, pa.list_(pa.int64()))], names=["rid", "all"])
    got = list(B._count(iter([batch.slice(0, 7), batch.slice(3, 2)])))
    assert len(got) > 2
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(7), 3, 4]
    assert [x for b in got for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())][:6] == [
        ([1, 5], [1, 2]), ([], []), ([], []), (list(range(30)), [1] * 30), ([2], [1]), ([2], [2])]


def test_best_rows_are_bounded_for_equal_scores():
    best = V.Best(3, 2)
    for at in range(0, 1000, 100):
        best.add(np.arange(3), np.full((3, 100), 0.5), np.arange(1000, 0, -1)[at:at + 100][::-1])
        assert best.added <= 4 * 2 * 3
    q, c, s = best.rows()
    assert list(zip(q, c)) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_every_rare_word_is_found(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices([f"common{j}" for j in range(30)], k=30)) + f" rareword{i}") for i in range(3000)]
    q = [(i, f"rareword{i * 7} common1") for i in range(50)]
    got = B.tfidf_retrieve(spark.createDataFrame(q, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, t string"), "d", "t",
                           top_k=1, q_name="q", c_name="d").collect()
    assert {(x.q, x.d) for x in got} == {(i, i * 7) for i in range(50)}
    # the classic cap is an option, and loses them
    capped = B.tfidf_retrieve(spark.createDataFrame(q, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, t string"), "d", "t",
                              top_k=1, max_features=900, q_name="q", c_name="d").collect()
    assert sum(x.d == x.q * 7 for x in capped) < 50


def test_part_and_empty_marker(spark):
    docs = [(1, "red apple", "x"), (2, "red apple", "y"), (3, "red apple", None), (4, None, "x")]
    c = spark.createDataFrame(docs, "d long, t string, part string")
    q = spark.createDataFrame([(10, "red", "x"), (11, "red", None), (12, "nothing", "x"), (13, None, "y")], "q long, t string, part string")
    got = B.tfidf_retrieve(q, "q", "t", c, "d", "t", part="part", mark_empty=True, q_name="q", c_name="d").collect()
    assert sorted((x.q, x.d, x["rank"]) for x in got if x.d is not None) == [(10, 1, 1)]
    assert sorted((x.q, x["rank"], x.score) for x in got if x.d is None) == [(11, 0, 0.0), (12, 0, 0.0), (13, 0, 0.0)]
    assert B.tfidf_retrieve(q, "q", "t", c.where("false"), "d", "t").count() == 0
    assert B.tfidf_retrieve(q.where("false"), "q", "t", c, "d", "t", mark_empty=True).count() == 0


def test_postings_are_pruned(spark, monkeypatch):
    """Frequent terms that cannot bring in a document are not looked up."""
    docs = [(i, f"the of and text number filler{i % 50} unique{i} special{i // 5}") for i in range(500)]
    q = [(1000 + i, f"special{i} unique{i * 5} the") for i in range(20)]
    index = B.build_index(spark.createDataFrame(docs, "d long, t string"), "d", "t")
    met, was = [], B._meet
    monkeypatch.setattr(B, "FORWARD_PAYS", 0)
    monkeypatch.setattr(B, "_meet", lambda post, some, *a: met.append(was(post, some, *a)) or met[-1])
    got = B.search(index, spark.createDataFrame(q, "q long, t string"), "q", "t", top_k=5, q_name="q", c_name="d").collect()
    assert {(x.q, x.d, x["rank"]) for x in got} == plain_search(q, docs, 5)
    assert met[1].count() < 20 * 500 / 10


# --------------------------------------------------------------- vectors

@pytest.mark.parametrize("part", [None, "label"])
@pytest.mark.parametrize("scan_bytes", [0, 64 << 20])
def test_vectors_nulls_are_alike_on_both_paths(spark, part, scan_bytes):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, None, "a"), (4, [0.0, 1.0], None), (5, [1.0, 0.2], None), (6, [0.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = {(x.query_id, x.case_id) for x in V.block_topk(df, df, 10, part=part, exclude_self=True, scan_bytes=scan_bytes).collect()}
    ids = [1, 2, 6] if part else [1, 2, 4, 5, 6]
    assert got == {(a, b) for a in ids for b in ids if a != b}
    none = df.where("false")
    for a, b in ((none, df), (df, none), (none, none)):
        out = V.block_topk(a, b, 3, part=part, scan_bytes=scan_bytes)
        assert out.columns == ["query_id", "case_id", "rank", "score"] and out.count() == 0


# --------------------------------------------------------- pruned top-k

def clustered(n, dims, spread, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(8, dims)) * 4
    return (centre[r.integers(0, 8, n)] + spread * r.normal(size=(n, dims))).round(3)


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_pruned_topk_is_exact_and_skips_cells(spark, kind):
    vecs = clustered(600, 8, 0.15) if kind == "clustered" else np.random.default_rng(4).normal(size=(600, 8)).round(3)
    vecs[5], vecs[7] = 0.0, vecs[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(600, None), (3, [float(x) for x in vecs[9]])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    cells = PT.build_cells(df, centroids=16, rings=4, block_rows=50)
    got, load = PT.pruned_topk(df, cells, 6, exclude_self=True, block_rows=40)
    want = V.block_topk(df.where("id <> 3"), df, 6, exclude_self=True)
    key = lambda t: {(x.query_id, x.case_id, x["rank"]) for x in t.where("query_id <> 3").collect()}
    assert key(got) == key(want)
    scanned = sum(x.scanned for x in load.collect())
    assert scanned <= 601 * len(cells.table)
    if kind == "clustered":
        assert scanned < 0.5 * 601 * len(cells.table)
    none = df.where("false")
    assert PT.pruned_topk(none, cells, 3)[0].count() == 0
    assert PT.pruned_topk(df, PT.build_cells(none), 3)[0].count() == 0


def test_bounds_hold_for_every_row():
    r = np.random.default_rng(6)
    x = V._unit(r.normal(size=(400, 5)))
    c = PT.fit_centroids(x[:200], 12)
    d = PT._distances(x, c)
    own, far = d.argmin(1), d.min(1)
    table = np.array([(e, e, far[own == e].min(), far[own == e].max(), (own == e).sum(), 1) for e in range(12) if (own == e).any()],
                     dtype=[("cell", int), ("centroid", int), ("lo", float), ("hi", float), ("n", int), ("salts", int)])
    q = V._unit(r.normal(size=(50, 5)))
    ub = PT.upper_bounds(q, c, table)
    for j, e in enumerate(table["cell"]):
        assert ((q @ x[own == e].T).max(1) <= ub[:, j] + 1e-9).all()


# ---------------------------------------------------------------- encoder

def hashed_matrix(spark, texts, buckets):
    """The weighed sparse matrix as a dense one, by plain loops."""
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = {r.i: r._cols for r in E.hashed_rows(df, "t", buckets, 2, "i").collect()}
    a = np.zeros((len(texts), buckets))
    for i, cols in rows.items():
        for c in cols:
            a[i, abs(c) - 1] += np.sign(c)
    df_ = np.array([sum(1 for c in rows.values() if b + 1 in {abs(x) for x in c}) for b in range(buckets)])
    a *= np.where(df_ > 0, np.log((1 + len(texts)) / (1 + df_)) + 1, 0)
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def test_encoder_equals_a_plain_decomposition(spark):
    r = random.Random(2)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("ship", "refund", "login", "price")]
    texts = [" ".join(r.choices(topics[i % 4], k=12)) for i in range(120)] + [None, "", "!"]
    a = hashed_matrix(spark, texts, 256)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    enc = E.fit(df, "t", rank=4, buckets=256, rounds=6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(enc.strength, s[:4], rtol=1e-3)
    angles = np.linalg.svd(vt[:4] @ enc.basis, compute_uv=False)      # the same subspace
    assert (angles > 0.999).all()
    got = {x.i: np.array(x.vec) for x in E.encode(df, "t", enc).select("i", "vec").collect()}
    assert all(np.allclose(got[i], a[i] @ enc.basis, atol=1e-9) for i in range(len(texts)))
    assert not got[120].any() and not got[121].any()
    near = V.block_topk(V.embed(df, E.featurizer(enc, "t")).select(F.col("i").alias("id"), "vec").where("i < 120"),
                        E.encode(df, "t", enc).select(F.col("i").alias("id"), "vec").where("i < 120"), 3, exclude_self=True).collect()
    assert np.mean([x.query_id % 4 == x.case_id % 4 for x in near]) > 0.95
    empty = E.fit(df.where("false"), "t", rank=2, buckets=16)
    assert not empty.basis.any() and E.encode(df, "t", empty).count() == len(texts)
