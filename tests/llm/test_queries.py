"""Every registered query against its SQL, or against a brute-force version."""
import base64
import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ticketlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()


def test_all_are_registered():
    names = set(queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and set(Q.ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = [tuple(norm(x) for x in r) for r in df.collect()]
    rel = duck.sql(Q.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(got, key=key) == sorted([tuple(norm(r[i]) for i in at) for r in rel.fetchall()], key=key)


def test_op1_base_counts_by_hand(spark, texts):
    got = {r.doc_id: r for r in queries()["op1_quality_gbt"](spark, SF).collect()}
    assert len(got) == len(texts)
    for doc_id, t in texts:
        words = t.encode().split()
        tri = Counter(zip(words, words[1:], words[2:]))
        hit = set()
        for i in range(len(words) - 2):
            if tri[tuple(words[i:i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        r = got[doc_id]
        want = (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_op6_against_all_pairs(spark, texts):
    def fp(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    fps = {d: fp(t) for d, t in texts}
    ids = sorted(fps)
    root = {i: i for i in ids}
    changed = True
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op6_simhash_gray"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def test_op9_finds_exactly_the_verbatim_copies(spark, duck, texts):
    clean = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}<>|*#%$&"})
    norm_ = lambda t: " " + " ".join(w.decode() for w in t.translate(clean).encode().lower().split()) + " "
    items = [(i, norm_(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in texts for i, x in items if x in norm_(t)}
    got = {(r.doc_id, r.item_id): r for r in queries()["op9_decontaminate_sw"](spark, SF).collect()}
    assert want <= set(got) and all(got[k].score == 1.0 for k in want)


def test_op8_beats_unigrams(spark, texts):
    got = queries()["op8_pseudo_likelihood"](spark, SF).toPandas()
    assert len(got) == len(texts)
    assert dict(zip(got.doc_id, got.n_tokens)) == {d: len(t.encode().split()) for d, t in texts}
    assert np.isfinite(got.log_prob).all() and (got.log_prob <= 0).all()


def test_op5_digest_by_hand(spark, duck):
    want = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
            for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    assert {r.page_id: r.payload_digest for r in queries()["op5_warc_zstd"](spark, SF).collect()} == want


def test_pipeline_stages(spark, texts):
    """Each stage against a plain restatement of what it must keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    q = {r.doc_id for r in queries()["op1_quality_gbt"](spark, SF).where("kept").collect()}
    a = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert a.columns == docs.columns and {r.doc_id for r in a.select("doc_id").collect()} == q
    b = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    want = {r.component_id for r in queries()["op6_simhash_gray"](spark, SF).collect()}
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.select("doc_id").collect()) == sorted(want)
    c = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    bad = {r.doc_id for r in queries()["op9_decontaminate_sw"](spark, SF).collect()}
    assert c.columns == docs.columns and {r.doc_id for r in c.select("doc_id").collect()} == {d for d, _ in texts} - bad
    d = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    clean = {r.doc_id for r in queries()["op10_secret_scan"](spark, SF).where("spans = ''").collect()}
    assert d.columns == docs.columns and {r.doc_id for r in d.select("doc_id").collect()} == clean
    e = corpus_pipeline.STAGES[4][1](spark, docs, SF).toPandas()
    assert set(e.doc_id) == {d for d, _ in texts}


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "pass", "block", "position"]
    assert got.count() > 0
