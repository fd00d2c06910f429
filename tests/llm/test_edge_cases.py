"""Nulls, empty and long texts, repeats, empty tables and clashing columns."""
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.llm import (common, decontaminate_sw, mixing, perspectives, pseudo_likelihood, quality_gbt, secrets_trigram,
                            simhash_gray, suffix_repeats, url_vocabulary, warc_zstd)

LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "one two"), (None, "null id here"), (4, LONG), (4, LONG), (5, "one two"),
        (None, "null id here"), (6, "One Two"), (4, "another text of four"), (7, " \t\n "), (8, "é\u00a0ü x")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_filters_keep_columns_and_rows(spark, make_docs, rows):
    docs = make_docs(rows, clashes=True)
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, None), (None, "w5 w6 w7 w8 w9 w10 w11 w12"), (2, "a b"), (2, "a b")], "item_id long, text string")
    none = bench.where("false")
    for got, want in [
        (quality_gbt.keep_good(docs, labels), 2 if rows else 0),            # the two long rows
        (decontaminate_sw.drop_contaminated(docs, bench), len(rows) - 2 if rows else 0),
        (decontaminate_sw.drop_contaminated(docs, none), len(rows)),
        (secrets_trigram.drop_with_secrets(docs), len(rows)),
        (suffix_repeats.remove_repeats(docs), len(rows)),
    ]:
        assert got.columns == docs.columns and got.count() == want
    if rows:
        cut = suffix_repeats.remove_repeats(docs).where("n_chars > 1000").collect()
        assert [r.text for r in cut] == ["", ""]


def test_simhash_keeps_one_of_each_class(make_docs):
    docs = make_docs(ROWS, clashes=True)
    got = simhash_gray.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect()) == sorted([
        (False, 1, None), (False, 3, "one two"), (True, None, "null id here"), (False, 4, LONG),
        (False, 4, "another text of four"), (False, 8, "é\u00a0ü x")], key=lambda x: (x[0], x[1], str(x[2])))
    rows = {(r.id, r.fingerprint, r.component) for r in simhash_gray.classes(docs).collect()}
    assert (1, 0, 1) in rows and (2, 0, 1) in rows and (7, 0, 1) in rows
    assert simhash_gray.classes(docs.where("false")).count() == 0


def test_gray_index_against_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = [int(b) for b in base]
    for b in base:
        for _ in range(15):
            x = int(b)
            for bit in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(bit)
            codes.append(x)
    fps = np.unique(np.array(codes, np.uint64))
    fps = fps[np.argsort(simhash_gray.gray_rank(fps))]
    got = {(int(a), int(b)) for x, y in simhash_gray.near_pairs(fps, 2, most=500) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_hot_fingerprint_keys_are_split_without_loss(spark):
    """A dense cluster whose key groups exceed the limit."""
    r = random.Random(5)
    codes = {r.getrandbits(20) << 3 for _ in range(30_000)}
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    got = {x.node: x.root for x in common.components(simhash_gray.links(df, "fp", 1), "a", "b").collect()}
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c
    for c in codes:
        for b in range(64):
            if c ^ (1 << b) in codes:
                x, y = find(c), find(c ^ (1 << b))
                parent[max(x, y)] = min(x, y)
    assert {c: got.get(c, c) for c in codes} == {c: find(c) for c in codes}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1050)}}


def test_removals_against_brute_force(make_docs):
    r = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(40):
        w = [f"x{r.randrange(500)}" for _ in range(r.randrange(0, 120))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            lo = r.randrange(0, 20)
            w[at:at] = passage[lo: lo + r.randrange(30, 50)]
        docs.append((i, " ".join(w)))
    docs += [(50, docs[3][1]), (51, "a " * 80), (52, None), (53, docs[9][1] + " tail")]
    from collections import Counter
    split = {d: (t or "").split() for d, t in docs}
    n = Counter(tuple(w[s:s + 35]) for w in split.values() for s in range(len(w) - 34))
    want = {}
    for d, w in split.items():
        gone = set()
        for s in range(len(w) - 34):
            if n[tuple(w[s:s + 35])] > 1:
                gone |= set(range(s, s + 35))
        want[d] = (len(w), len(gone), suffix_repeats._digest([x.encode() for i, x in enumerate(w) if i not in gone]))
    for rows in (200_000, 3):       # small groups force longer prefixes
        got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_repeats.removals(make_docs(docs), group_rows=rows).collect()}
        assert got == want


def test_monotone_trees():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality_gbt.FEATURES)))
    y = ((x[:, 2] < 0.6) & (x[:, 0] > 0.2) ^ (r.random(3000) < 0.05)).astype(float)
    m = quality_gbt.train_trees(x, y, monotone=quality_gbt.MONOTONE, n_trees=25)
    p = quality_gbt.predict(m, x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9
    for f, s in enumerate(quality_gbt.MONOTONE):
        if s:
            lo, hi = x.copy(), x.copy()
            lo[:, f], hi[:, f] = 0.0, 1.0
            mid = x.copy()
            mid[:, f] = 0.5
            a, b, c = (quality_gbt.predict(m, z) * s for z in (lo, mid, hi))
            assert (b >= a - 1e-12).all() and (c >= b - 1e-12).all()


def test_held_out_quality(spark):
    """Good documents that the trees never saw are kept, junk is mostly found."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    m = quality_gbt.fit(docs, odd)
    got = (docs.join(labels.where("doc_id % 2 = 0"), "doc_id").select("quality", quality_gbt.verdicts(F.col("text"), m).alias("v"))
               .select("quality", "v.*").toPandas())
    good = got[got.quality == 1]
    assert (good.p_good >= m["threshold"]).mean() > 0.97
    assert (got[got.quality == 0].kept).mean() < 0.3


def test_edited_copies_are_found(spark, make_docs):
    r = random.Random(2)
    item = [f"term{i}" for i in range(40)]
    docs, want = [], set()
    for i in range(30):
        w = [f"x{r.randrange(5000)}" for _ in range(200)]
        if i % 2:
            copy = list(item)
            for k in r.sample(range(40), 4):
                copy[k] = "edited"
            del copy[r.randrange(40)]
            w[50:50] = [x.upper() + "," for x in copy]
            want.add(i)
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(item)) for i in range(300)]       # a hot group: most documents are the item
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "x y")], "item_id long, text string")
    got = {r.id: r for r in decontaminate_sw.contaminations(make_docs(docs), bench).collect()}
    assert set(got) == want | {100 + i for i in range(300)}
    assert all(0.6 <= got[i].score < 1 and 45 <= got[i].first_word <= 55 for i in want)


def test_seeds_lose_no_alignment_that_reaches_the_score():
    """Random and even edits of a fifth to a quarter of the words, and a word
    put in after every two, against aligning every item with every text."""
    r = random.Random(5)
    items = [[f"i{k}w{j}" if r.random() < 0.6 else f"c{r.randrange(20)}" for j in range(m)]
             for k, m in enumerate((4, 5, 6, 9, 15, 25, 40, 59))]
    texts = []
    for k, item in enumerate(items):
        for rate in (4, 5, 3):
            texts.append([("edited" if j % rate == rate - 1 else w) for j, w in enumerate(item)])
        texts.append([x for j, w in enumerate(item) for x in ((w, "extra") if j % 2 else (w,))])
        for share in (0.2, 0.25):
            for _ in range(8):
                texts.append([x for w in item for x in ((w,) if r.random() > share else r.choice([("edited",), (), (w, "extra")]))])
    texts = [[f"c{r.randrange(20)}" for _ in range(60)] + t + [f"c{r.randrange(20)}" for _ in range(60)] for t in texts]
    number = {w: n for n, w in enumerate({w for t in [*items, *texts] for w in t})}
    code = lambda ws: np.array([number[w] for w in ws])
    want = {}
    for n, t in enumerate(texts):
        for k, item in enumerate(items):
            score, _ = decontaminate_sw.align(code(item), code(t))
            if score >= 0.6 * 2 * len(item):
                want[n, k] = score / (2 * len(item))
    assert len(want) > 80
    for size in (1, 2):
        mine = [" ".join(x) if (len(x) > 5) == (size == 2) else None for x in items]
        g = decontaminate_sw.Grams(mine, size)
        for df in (np.zeros(g.size), np.random.default_rng(0).random(g.size)):      # whatever is counted
            seed = decontaminate_sw.seeds(g, df, 0.6)
            got = {(n, k): s for n, t in enumerate(texts)
                   for k, s, _, _ in decontaminate_sw.find_items(g, seed, [w.encode() for w in t], 0.6)}
            assert got == {(n, k): s for (n, k), s in want.items() if mine[k]}


@pytest.mark.parametrize("copies, others", [(300, 30), (1, 12)])
def test_edited_copies_without_common_grams_are_found(make_docs, copies, others):
    """A hot group of one copy with every fifth word replaced, and a small table."""
    r = random.Random(3)
    item = [f"term{i}" for i in range(40)]
    hot = " ".join("edited" if i % 5 == 4 else w for i, w in enumerate(item))
    docs = [(i, hot) for i in range(copies)] + [(1000 + i, " ".join(f"x{r.randrange(50)}" for _ in range(80))) for i in range(others)]
    bench = make_docs([]).sparkSession.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.id: round(r.score, 6) for r in decontaminate_sw.contaminations(make_docs(docs), bench).collect()}
    assert got == dict.fromkeys(range(copies), 0.7125)        # 32 matches and 7 replacements before the last word
    assert decontaminate_sw.drop_contaminated(make_docs(docs), bench).count() == others


def test_secret_spans_by_hand(spark, make_docs):
    t = "é password= 'abcdefgh12' AKIA" + "B" * 12 + " secret: short token=" + "0" * 40 + " AKIAshort"
    docs = make_docs([(1, t), (1, t), (2, None), (3, "ghp_" + "z" * 36)], clashes=True)
    got = {(r.id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets_trigram.scan(docs).collect()}
    a = t.index("password"), t.index("AKIA"), t.index("token"), t.index("0" * 40)
    assert got == {(1, (("assign", a[0], t.index("12'") + 2), ("access", a[1], a[1] + 16), ("assign", a[2], a[3] + 40),
                        ("hex", a[3], a[3] + 40))), (2, ()), (3, (("github", 0, 40),))}
    assert secrets_trigram.trigram_query("[0-9a-f]+") == []
    assert secrets_trigram.trigram_query("(abc|abd)x?[0-9]{4}") == [frozenset({"abc"}), frozenset({"abd"})]


def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i}", "<p>" + "text " * (i % 50)) for i in range(300)] + [
        (1000, None, None), (1001, "u", ""), (None, "n", "<p>"), (5, "http://h/5", "<p>" + "text " * 5), (2000, "l", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("revisit", F.lit("own"))
    got = warc_zstd.archive_and_read(df, archive_bytes=1 << 16).collect()
    assert sorted((r.id is None, r.id, r.url) for r in got if r.id is not None) == sorted(
        (False, i, u or "") for i, u, _ in pages if i is not None)
    text = {}
    for i, _, h in pages:
        text[i] = (h or "").encode()
    for r in got:
        assert r.payload_bytes == len(text[r.id]) and r.payload_digest == warc_zstd.payload_digest(text[r.id])
        assert r.record_type == "revisit" or bytes(r.payload) == text[r.id]
    by = {}
    for r in got:
        by.setdefault(text[r.id], []).append(r)
    for rows in by.values():
        first = [r for r in rows if r.record_type == "response"]
        assert len(first) == 1 and all(r.refers_to == first[0].id for r in rows if r.record_type == "revisit")
        assert first[0].id == min((r.id for r in rows if r.id is not None), default=None)
    assert warc_zstd.archive_and_read(df.where("false")).count() == 0


def test_archive_layout():
    records = [warc_zstd.record_bytes(str(i), "u", b"<p>some page %d</p>" % i * 40, "D", None) for i in range(200)]
    data = warc_zstd.archive_bytes_of(records, 4096, 1 << 20, 3)
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and n > 0 and data[8 + n: 12 + n] == warc_zstd.FRAME_MAGIC
    assert list(warc_zstd.read_archive(data)) == records
    with pytest.raises(Exception):
        list(warc_zstd.read_archive(data[:-5]))


def test_payloads_that_differ_from_their_headers_are_noticed(spark, tmp_path):
    page, good = b"<p>the page</p>", warc_zstd.payload_digest(b"<p>the page</p>")
    files = spark.createDataFrame([("pages-1.warc.zst",)], "file string")
    for k, (kept, digest, fails) in enumerate([(page, good, False), (b"<p>the pagE</p>", good, True), (page, "A" * 32, True)]):
        raw = warc_zstd.record_bytes("1", "u", page, digest, None).replace(page, kept)
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "pages-1.warc.zst").write_bytes(warc_zstd.archive_bytes_of([raw], 4096, 1 << 20, 3))
        got = warc_zstd.read_archives(files, str(tmp_path / str(k)))
        if fails:
            with pytest.raises(Exception, match="the headers say"):
                got.collect()
        else:
            assert [(r.payload_digest, r.payload_bytes, bytes(r.payload)) for r in got.collect()] == [(good, len(page), page)]


def test_urls_by_hand(spark):
    rows = [(1, None), (2, "no scheme porn"), (3, "http://A.Example.NET/en/x?y#z"), (4, "http://example.net"),
            (5, "http://x.com/cheap-pills"), (6, "http://x.com/cheapest"), (7, "http://notexample.net.com/"), (8, "x://example.com/de/?q")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           df.select("page_id", url_vocabulary.judge(F.col("url")).alias("j")).select("page_id", "j.*").collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "block"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
                   4: ("example.net", "", None, "allow"), 5: ("x.com", "/cheap-pills", None, "block"),
                   6: ("x.com", "/cheapest", None, "allow"), 7: ("notexample.net.com", "/", None, "allow"),
                   8: ("example.com", "/de/", "example.com/de/", "block")}


def test_vocabulary_from_a_table_and_long_urls(spark):
    table = spark.createDataFrame([("BadWord", "strict"), ("maybe", "soft"), ("perhaps", "soft"), (None, "soft"), ("", "strict"), ("x", "other")],
                                  "term string, weight string")
    strict, soft = url_vocabulary.load_vocabulary(table)
    assert (strict, soft) == (["badword"], ["maybe", "perhaps"])
    rows = [("http://a.b/" + "x" * 200_000 + "/badword", "block"), ("http://a.b/maybe/maybe", "allow"), ("perhaps-maybe", "block"), ("http://a.b/badwords", "allow")]
    df = spark.createDataFrame(rows, "url string, want string").withColumn("host", F.lit("own"))
    got = df.select("want", url_vocabulary.judge(F.col("url"), strict=strict, soft=soft).alias("j")).collect()
    assert [x.j.verdict for x in got] == [x.want for x in got]
    assert df.where("false").select(url_vocabulary.judge(F.col("url")).alias("j")).count() == 0
    with pytest.raises(ValueError):
        url_vocabulary.load_vocabulary(table, max_terms=1)


def test_scores_of_edge_cases(make_docs):
    got = {r.id: r for r in pseudo_likelihood.score_documents(make_docs(ROWS, clashes=True)).collect()}
    assert got[1].n_tokens == 0 and got[1].log_prob == 0.0 and got[1].mean_log_prob is None
    assert got[3].log_prob < 0 and got[7].n_tokens == 0
    assert pseudo_likelihood.score_documents(make_docs([])).count() == 0


def test_network_learns_context():
    """A token that follows from its neighbours is predicted far above chance."""
    r = np.random.default_rng(0)
    x = r.integers(0, 8, 60_000).astype(np.int32)
    x[1::2] = (x[0::2] + 3) % 8
    x = np.concatenate([[8, 8], x, [8, 8]]).astype(np.int32)
    net = pseudo_likelihood.Network(8, 8, np.log(np.full(8, 1 / 8)))
    at, state = np.arange(2, len(x) - 2), None
    state = net.fresh_state()
    for _ in range(3):
        net.train(x, at[:50_000], state, 0.01)
    lp = net.log_probs(x, at[50_000:], net.pairs())
    assert lp.mean() > np.log(1 / 8) + 0.3
    # the fast tables give what the plain sums give
    i = at[:100]
    h = np.tanh(sum(net.p[0][k][x[i + o]] for k, o in enumerate(net.offsets())) + net.p[1])
    z = h @ net.p[2] + net.p[3]
    want = z[np.arange(100), x[i]] - np.log(np.exp(z).sum(1))
    assert np.allclose(net.log_probs(x, i, net.pairs()), want, atol=1e-4)


def test_every_word_has_its_own_probability(make_docs):
    """Words within a class and the unseen mass sum to one, rare words come
    by the join as they come from the tasks, and nonsense costs more."""
    r = random.Random(4)
    docs = make_docs([(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(60))) for i in range(80)] + [(900, None), (901, "")])
    m = pseudo_likelihood.fit(docs, top_words=5, classes=4)
    for c in range(4):
        seen = np.exp(m.known.logs[m.known.tokens == 5 + c]).sum()
        assert abs(seen + pseudo_likelihood.DISCOUNT * m.distinct[c] / m.total[c] - 1) < 1e-9
    few = m._replace(known=pseudo_likelihood.Known([], np.zeros(0, np.int64), np.zeros(0)))
    a, b = ({x.id: (x.n_tokens, x.log_prob) for x in pseudo_likelihood.score_rows(docs, k).collect()} for k in (m, few))
    assert set(a) == set(b) == {*range(80), 900, 901}
    assert all(a[i][0] == b[i][0] and abs(a[i][1] - b[i][1]) < 1e-3 for i in a)
    word = next(w for w, t in zip(m.known.words, m.known.tokens) if t == 5).decode()       # the commonest of a class
    same = next(f"nonsense{i}" for i in range(1000) if m.vocab.encoder()[f"nonsense{i}".encode()] == 5)
    got = {x.id: x.log_prob for x in pseudo_likelihood.score_rows(make_docs([(1, f"w1 {word} w1"), (2, f"w1 {same} w1")]), m).collect()}
    assert got[1] > got[2] + 10


def test_held_out_words_beat_a_full_unigram_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    m = pseudo_likelihood.fit(train)
    got = pseudo_likelihood.score_rows(test, m).toPandas()
    n = {x.word.encode(): x.n for x in m.counts.collect()}
    total, d, want = sum(n.values()), pseudo_likelihood.DISCOUNT, 0.0
    for (t,) in test.select("text").collect():
        for w in (t or "").encode().split():
            want += np.log((n[w] - d) / total) if w in n else np.log(d * len(n) / total) - (len(w) + 1) * np.log(257)
    assert got.log_prob.sum() > want


def test_mixture_properties(make_docs):
    rows = [(i, "w " * (10 + i % 7), "big") for i in range(300)] + [(1000 + i, "w " * 10, "small") for i in range(20)]
    rows += [(2000, None, "void"), (2001, "w w", None), (1000, "w " * 10, "small")]
    docs = make_docs(rows, clashes=True)
    got = mixing.mix(docs, block_tokens=500, range_rows=16, max_repeats=3.0).toPandas()
    uses = got.groupby("id").size()
    assert set(got["id"]) == {r[0] for r in rows} and uses.loc[0] == 1
    tokens = got.groupby("source", dropna=False).n_tokens.sum()
    for b, g in got.groupby("block"):
        assert sorted(g.position) == list(range(1, len(g) + 1))
    inner = got[(got.block > 0) & (got.block < got.block.max())].groupby(["block", "source"]).n_tokens.sum().unstack()
    want = tokens["big"] / tokens.sum()
    assert abs((inner["big"] / inner.sum(axis=1)).mean() - want) < 0.05
    assert mixing.mix(make_docs([])).count() == 0
    again = mixing.mix(docs.repartition(5), block_tokens=500, range_rows=16, max_repeats=3.0).toPandas()
    cols = ["block", "position", "id", "pass"]
    assert got[cols].sort_values(cols).reset_index(drop=True).equals(again[cols].sort_values(cols).reset_index(drop=True))


def test_rows_without_tokens_and_equal_rows_spread_over_the_blocks(spark, make_docs):
    """A source without a token goes to all blocks; equal rows draw apart."""
    rows = [(i, None, "void") for i in range(2000)] + [(None, "w w", "copies")] * 1500 + [(10_000 + i, "w " * 20, "big") for i in range(300)]
    got = mixing.mix(make_docs(rows), block_tokens=600, range_rows=50).toPandas()
    n = got.block.max() + 1
    assert n >= 10 and len(got[got.source == "void"]) == 2000
    for source in ("void", "copies"):
        per = got[got.source == source].groupby("block").size()
        assert len(per) >= n - 1 and per.max() < 3 * per.mean()
    docs = make_docs(rows)
    t = docs.selectExpr("doc_id AS id", "source", "coalesce(size(split(text, ' ')), 0) AS n_tokens").repartition(3)
    ties = mixing._with_ties(t, chunk=100).where("source = 'copies'").toPandas().tie
    assert sorted(ties) == list(range(1500))


def test_small_archives_have_dictionaries(spark, tmp_path):
    """Sixty-four partitions of a few pages, one of a single short page, and
    archives of few large records."""
    r = random.Random(7)
    words = [f"<div class='c{i}'>text{i * i}</div>" for i in range(60)]
    rows = [(i, f"http://x/{i}", "<html>" + " ".join(r.choices(words, k=40)) + "</html>") for i in range(190)] + [(999, "u", "short"), (1000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(64)
    folder = str(tmp_path / "few")
    files = warc_zstd.write_archives(pages, folder).collect()
    sizes = []
    for f in files:
        data = (tmp_path / "few" / f.file).read_bytes()
        sizes.append(struct.unpack("<I", data[4:8])[0])
        assert len(list(warc_zstd.read_archive(data))) == f.n_records
    assert sum(f.n_records for f in files) == len(rows) and min(sizes) > 0
    big = [("head " * 3 + "".join(r.choices("abcdef ", k=60_000))).encode() for _ in range(3)]
    assert warc_zstd.train_dictionary(big, 64 << 10, 1 << 20)
    sample = warc_zstd.pieces_of([b"x" * n for n in (1, 50_000, 3, 4096, 0, 200_000)], 64 << 10)
    assert sum(map(len, sample)) <= (64 << 10) + 4096 and len(sample) >= 8


def test_entropy_target(spark):
    s = spark.createDataFrame([("a", 700, 1), ("b", 200, 1), ("c", 100, 1)], "source string, tokens long, n_docs long")
    a = mixing.exponent(s, entropy=1.0)
    p = np.array([0.7, 0.2, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.0) < 1e-4


def test_rotation_parts_and_edge_cases(spark):
    rows = [(1, i, "ab"[i % 2] if i else "system", f"t{i}") for i in range(10)] + [
        (None, 0, None, None), (None, None, "", "<|im_end|>"), (2, 0, "system", "only"), (3, 0, "u", "x"), (3, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("own"))
    whole = {(r.conv, r.participant): r for r in perspectives.rotate(df).collect()}
    assert set(whole) == {(1, "a"), (1, "b"), (None, "unknown"), (3, "u")}
    assert whole[(3, "u")].n_turns == 2 and whole[(None, "unknown")].text.count("<|im_end|>") == 2
    for r in whole.values():
        for s in r["mask"]:
            assert r.text[s.start: s.end].endswith("<|im_end|>") and r.text[:s.start].endswith("<|im_start|>assistant\n")
    parts = perspectives.rotate(df, part_turns=3).orderBy("part").collect()
    for k, r in whole.items():
        assert "".join(p.text for p in parts if (p.conv, p.participant) == k) == r.text
    assert perspectives.rotate(df.where("false")).count() == 0


def test_outputs_with_clashing_columns(spark, make_docs):
    """Extra columns named like the operators' own do not change a result."""
    docs, plain = make_docs(ROWS, clashes=True), make_docs(ROWS)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(simhash_gray.classes(docs)) == key(simhash_gray.classes(plain))
    bench = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    clash = bench
    for c in ("id", "item", "n", "k", "score"):
        clash = clash.withColumn(c, F.lit("own"))
    got = decontaminate_sw.contaminations(docs, clash)
    assert key(got) == key(decontaminate_sw.contaminations(plain, bench)) and got.count() == 2
    assert decontaminate_sw.contaminations(docs.where("false"), bench).count() == 0


def test_a_very_long_turn(spark):
    long = "word " * 100_000
    df = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "x")], "conv_id long, turn long, role string, text string")
    got = {r.participant: r for r in perspectives.rotate(df).collect()}
    assert all(long in r.text for r in got.values())
    assert [(s.start, s.end) for s in got["a"]["mask"]] == [(len("<|im_start|>assistant\n"), len("<|im_start|>assistant\n") + len(long) + len("<|im_end|>"))]


def test_the_corpus_is_written_and_scratch_tables_go(spark, tmp_path):
    import os

    import corpus_pipeline
    from ticketlake import session
    before = len(session._WRITTEN)
    corpus_pipeline.write(spark, "/root/testdata/sf0.001", str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() > 0 and len(session._WRITTEN) == before
    with session.scratch_tables(spark):
        common.written(spark.range(3).toDF("x"), "few")
        path = session._WRITTEN[-1].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
