"""The scan of texts by few queries, pairs of blocks, and masks that are computed once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_retrieval import corpus_of, plain_search
from ticketlake.operators import postings as B
from ticketlake.operators import quality as Q
from ticketlake.operators import vectors as V
from ticketlake.plans import pipeline as P


def test_pair_hashes_are_those_of_spark(spark):
    r = random.Random(2)
    rows = [(r.getrandbits(64) - 2**63, r.getrandbits(64) - 2**63) for _ in range(500)] + [(0, 0), (-1, 2**63 - 1)]
    want = [x[0] for x in spark.createDataFrame(rows, "a long, b long").coalesce(1).select(F.xxhash64("a", "b")).collect()]
    a, b = np.array(rows, np.int64).T
    assert B._hash_pairs(a.copy(), b.copy()).tolist() == want


@pytest.mark.parametrize("run_terms,sub_terms,heavy,cells", [(750_000, 2_000_000, 8, 16_000_000), (200, 300, 1, 50)])
def test_few_queries_scan_the_texts(spark, monkeypatch, run_terms, sub_terms, heavy, cells):
    """No index of the corpus is built and no vector written; repeated and null keys are rows of their own."""
    monkeypatch.setattr(B, "build_index", None)
    monkeypatch.setattr(B, "RUN_TERMS", run_terms)
    monkeypatch.setattr(B, "SUB_TERMS", sub_terms)
    monkeypatch.setattr(B, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(B, "SUM_CELLS", cells)
    r = random.Random(5)
    docs = corpus_of(r, 120) + [(900, None), (901, ""), (902, "! ?")]
    queries = [(1000 + i, t) for i, (_, t) in enumerate(corpus_of(r, 9))] + [(3, docs[3][1]), (4, None), (5, "nowhere")]
    c = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "q long, text string")
    got = B.tfidf_retrieve(q, "q", "text", c, "doc_id", "text", top_k=4, exclude_self=True, mark_empty=True, q_name="q", c_name="d").collect()
    assert {(x.q, x.d, x["rank"]) for x in got if x["rank"]} == plain_search(queries, docs, 4, exclude_self=True)
    assert {x.q for x in got if not x["rank"]} == {4, 5}
    twice = [(7, "alpha beta"), (7, "alpha beta"), (None, "alpha gamma"), (8, "delta")]
    got = B.tfidf_retrieve(q.limit(0).unionByName(spark.createDataFrame([(1, "alpha beta")], "q long, text string")), "q", "text",
                           spark.createDataFrame(twice, "d long, t string"), "d", "t", q_name="q", c_name="d").collect()
    assert [(x.d, x["rank"]) for x in sorted(got, key=lambda x: x["rank"])] == [(7, 1), (7, 2), (None, 3)]


def _block(r, n, parts):
    sizes = r.integers(0, 12, n)
    tids = [np.sort(r.choice(np.concatenate((np.arange(6), r.integers(6, 400, 30))), s)) for s in sizes]
    tids = [np.unique(t) for t in tids]
    return {"rid": pa.array(range(n)), "id": pa.array([None if i % 17 == 0 else int(i) for i in r.integers(0, n, n)], pa.int64()),
            "part": pa.array([parts[i] for i in r.integers(0, len(parts), n)], pa.string()), "sizes": pa.array([len(t) for t in tids]),
            "tids": pa.array(np.concatenate(tids).astype(np.int64)), "ws": pa.array(r.random(sum(map(len, tids))) + 0.01)}


@pytest.mark.parametrize("exclude_self,by_part", [(False, False), (True, False), (True, True)])
def test_dense_and_split_pairs_keep_every_score(monkeypatch, exclude_self, by_part):
    """Common terms by matrix products and pairs of equal parts alone: the same best as term by term over all pairs."""
    r = np.random.default_rng(4)
    q, c = _block(r, 60, [None, "a", "b", "c"]), _block(r, 90, [None, "a", "b"])
    got = {}
    for pays, parts in ((0, 0), (64, 64), (1e9, 64), (64, 0)):
        monkeypatch.setattr(B, "DENSE_PAYS", pays)
        monkeypatch.setattr(B, "MOST_PARTS", parts)
        t = B._found_fn(5, 0.01, exclude_self, by_part)(None, q, c)[0].to_pylist()
        got[pays, parts] = sorted((x["q"], x["rid"], round(x["s"], 9)) for x in t)
    assert got[0, 0] and all(x == got[0, 0] for x in got.values())


def test_pairs_of_other_parts_are_not_scored(monkeypatch):
    cells, add = [], V.Best.add
    monkeypatch.setattr(V.Best, "add", lambda self, rows, S, ids: (cells.append(S.size), add(self, rows, S, ids)) and None)
    r = np.random.default_rng(4)
    q, c = _block(r, 60, ["a", "b", "c", "d"]), _block(r, 90, ["a", "b", "c", "d"])
    B._found_fn(5, 0.01, True, True)(None, q, c)
    n = lambda x, p: x["part"].to_pylist().count(p)
    assert sum(cells) == sum(n(q, p) * n(c, p) for p in "abcd") < 60 * 90


def test_masks_are_computed_once(spark):
    """A filter on the reason and the labels read masked texts; they do not mask again."""
    conv = spark.createDataFrame([(1, "x", "my parcel is late, a@b.co", "sorry, we help", 2)],
                                 "conversation_id long, conversation string, customer_problem string, brand_responses string, turn_count long")
    plan = P.label_valid(Q.processed_conversations(conv))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[EMAIL]") == 3
