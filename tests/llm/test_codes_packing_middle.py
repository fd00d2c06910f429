"""Trie codes, best-fit packing and fill-in-middle: brute force, round trips, edge cases."""
import bisect
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from ticketlake.llm import best_fit, fill_in_middle, trie_codes

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "one two"), (None, "null id here"), (4, LONG), (4, LONG), (5, "one two"), (None, "null id here"),
        (6, "a <P> b"), (7, " \t\n "), (8, "é ü x é 🙂👍🏽"), (9, "x\u0000y")]


# ------------------------------------------------------------------ op11

def plain_codes(vectors, books):
    """Nearest entries by plain loops over Python integers."""
    w = len(books[0][0])
    out = []
    for v in vectors:
        code, error = [], 0
        for p, book in enumerate(books):
            part = v[p * w:(p + 1) * w]
            d, e = min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
            code.append(e)
            error += d
        out.append((code, error))
    return out


def test_walk_against_plain_distances(monkeypatch):
    monkeypatch.setattr(trie_codes, "SUBTREE", 5)           # so that the stack descends
    r = np.random.default_rng(1)
    for w, spread in ((1, 3), (3, 2), (4, 50), (6, 1)):
        parts = r.integers(-spread, spread + 1, (300, w))
        book = r.integers(-spread, spread + 1, (7, w))
        leaves, splits, leaf = trie_codes.trie_leaves(parts)
        assert (leaves[leaf] == parts).all() and len(np.unique(parts, axis=0)) == len(leaves)
        assert [tuple(x) for x in leaves] == sorted(map(tuple, leaves))
        entry, far = trie_codes.walk(leaves, splits, book)
        all_far = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (entry[leaf] == all_far.argmin(1)).all() and (far[leaf] == all_far.min(1)).all()


def test_prefixes_share_their_distances():
    """The path of a subtree is added up once: nodes, not leaves times width."""
    parts = np.array([[5, 5, 5, i] for i in range(1000)])
    leaves, splits, _ = trie_codes.trie_leaves(parts)
    assert splits[0] == 0 and (splits[1:] == 3).all()


@pytest.mark.parametrize("chunk", [4 << 20, 64])
def test_codes_against_plain_rounds(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie_codes, "CHUNK_VALUES", chunk)
    r = random.Random(4)
    rows = [(i, [round(r.gauss(0, 0.2), 2) for _ in range(8)], r.choice([None, 1, 2])) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {x.id: x for x in trie_codes.compress(df, parts=4, entries=6, rounds=2).collect()}
    f = lambda x: int(np.floor(256 * np.float64(np.float32(x))))
    vectors = [[f(x) for x in v] for _, v, _ in rows]
    books = [[v[p * 2:p * 2 + 2] for v in vectors[:6]] for p in range(4)]
    for _ in range(2):
        codes = plain_codes(vectors, books)
        for p in range(4):
            for e in range(6):
                mine = [v[p * 2:p * 2 + 2] for v, (c, _) in zip(vectors, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = plain_codes(vectors, books)
    by_label = {}
    for (_, _, label), (_, error) in zip(rows, codes):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    for (i, _, label), (code, error) in zip(rows, codes):
        x = got[i]
        assert (x.code, x.error, x.group_error, x.codebooks_sha256) == ("".join(f"{c:02x}" for c in code), error, by_label[label], sha)


def test_codes_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [None, 1.0], 2),
            (None, [1.0, -1.0], None), (6, [1e30, -1e30], None), (7, [1.0, 2.0, 3.0], 9), (8, [], 9), (9, [0.5, 0.25], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("id", "vec", "grp", "code", "error", "s", "n"):
        df = df.withColumn(c, F.lit("own"))
    got = {(x.id, x.code is None): x for x in trie_codes.compress(df, parts=2, entries=2, rounds=1).collect()}
    assert set(got) == {(1, False), (None, False), (6, False), (7, True), (8, True), (9, False)}
    assert got[1, False].error == 0 and got[7, True].error is None and got[7, True].group_error is None
    assert got[6, False].error == trie_codes.LONGEST
    none = trie_codes.compress(df.where("false"))
    assert none.count() == 0 and none.columns == ["id", "code", "error", "group_error", "codebooks_sha256"]
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 4.0], 0)], "vec_id long, embedding array<double>, label int")
    x = trie_codes.compress(odd, parts=2, entries=1, rounds=0).orderBy("id").collect()       # 3 of 4 components are real
    assert [r.error for r in x] == [0, 256 ** 2]
    assert x[0].codebooks_sha256 == hashlib.sha256(b"256,512,768").hexdigest()


# ------------------------------------------------------------------ op12

def check_packing(rows, capacity=4096):
    """Every sequence is filled from 0 without a gap, up to the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            g = gaps.pop(i)
        else:
            g, n = capacity, n + 1
        bisect.insort(gaps, g - x)
    return n


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "large", "thirds"])
def test_sequences_are_few(spark, kind):
    r = random.Random(kind)
    n = 400
    lengths = {"mixed": [r.randint(1, 100) if r.random() < 0.6 else r.randint(1, 12) for _ in range(n)], "equal": [9] * n,
               "tiny": [1] * n, "large": [r.randint(51, 100) for _ in range(n)], "thirds": [r.randint(20, 50) for _ in range(n)]}[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long").repartition(4)
    got = best_fit.pack(items, 100).join(items, "pid").collect()
    assert sorted(x.pid for x in got) == list(range(n))
    used = check_packing(got, 100)
    assert used <= 1.03 * best_fit_decreasing(lengths, 100) + 1


def test_brackets_against_a_stack():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 500):
        opens = r.random(n) < 0.5
        stack, want = [], set()
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        a, b, _ = best_fit.brackets(opens)
        assert set(zip(a.tolist(), b.tolist())) == want


def test_a_sweep_over_many_ranges_is_one_sweep(spark):
    """Each document, the longest first, takes the least gap that fits."""
    r = random.Random(8)
    docs = [(i, r.randint(1, 40)) for i in range(300)]
    gaps = [(1000 + i, r.randint(1, 40)) for i in range(250)]
    free, want = sorted((g, s) for s, g in gaps), 0
    for _, x in sorted(docs, key=lambda d: -d[1]):
        i = bisect.bisect_left(free, (x, -1))
        if i < len(free):
            want += 1
            free.pop(i)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")        # eight ranges
    try:
        got, now, _ = best_fit._match(spark.createDataFrame(docs, "pid long, length long"),
                                   spark.createDataFrame(gaps, "seq long, gap long"), 40, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    rows = got.collect()
    both = [x for x in rows if x.seq is not None and x.pid is not None]
    assert len(both) == now["taken"] == want and all(x.length <= x.gap for x in both)
    assert sorted(x.pid for x in rows if x.pid is not None) == list(range(300))
    assert sorted(x.seq for x in rows if x.seq is not None) == [s for s, _ in gaps]
    left = sorted((x.rank, -x.length) for x in rows if x.seq is None)
    assert [k for k, _ in left] == list(range(now["left"])) and [x for _, x in left] == sorted(x for _, x in left)


def test_pieces_and_ids_of_edge_cases(spark, make_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = make_docs([*ROWS, (10, "ΟΔΟΣ ΑΣ Σ's İstanbul ﬁ don't 한국어 áb"), (11, " ".join(["<P>"] * 2000))], clashes=True)
    packed = best_fit.pack_documents(docs, capacity=512, with_ids=True).cache()
    got = packed.collect()
    check_packing(got, 512)
    by = {}
    for x in sorted(got, key=lambda x: (str(x.id), x.start)):
        by.setdefault(x.id, []).append(x)
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        assert x.start == 512 * x.piece
    for doc_id, text in {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}.items():
        copies = sum(1 for r in docs.collect() if r.doc_id == doc_id)
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        ids = {}
        for x in by[doc_id]:
            ids.setdefault(x.piece, []).append(list(x.ids))
        assert all(len(v) == copies for v in ids.values())
        assert sum((ids[k][0] for k in sorted(ids)), []) == want
    seqs = best_fit.sequences(packed).collect()
    assert sum(len(s.ids) for s in seqs) == sum(x.length for x in got) and all(len(s.ids) <= 512 for s in seqs)
    packed.unpersist()
    assert best_fit.pack_documents(docs.where("false")).count() == 0


def test_worker_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(best_fit, "REMEMBERED", 50)
    monkeypatch.setattr(best_fit, "REMEMBERED_PARTS", 50)
    ids = best_fit.WordIds(None)
    text = " ".join(f"w{i % 97} common" for i in range(500))
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids(text), "<u4").tolist() == want and max(map(len, (ids, ids.old, ids.parts, ids.old_parts))) <= 52


def test_ids_of_words_are_those_of_the_text():
    """Letters beyond ASCII, combining marks, controls, contractions, digits,
    final sigmas and names of special tokens, on the short way and the long."""
    ids = best_fit.WordIds(None)
    r = random.Random(1)
    texts = ["ΑΣ ΟΔΟΣ's don't x\x1cy \x85 é İstanbul ﬁ 's't 've <|endoftext|> a\x00b   z 1234 ½ ²", "Σ Σ. ΣΑΣ's ́ leading mark",
             "\u3000全角\u3000space 한국어한 ÀÉ×÷ŉŸſ ŒUVRE ßẞ l'ÉTÉ 'LL'Re d'D h\u0331 H\u0331", ""]
    texts += ["".join(r.choice("aB'sStTdDlLm1 ,.éÉİıŒßſŉ×\x1f\x7f~'eΣ\u0301\n") for _ in range(60)) for _ in range(2000)]
    assert ids.short
    for short in (True, False):
        ids.short = short
        ids.clear()
        ids.old.clear()
        for t in texts:
            assert np.frombuffer(ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_op12_packs_every_document(spark):
    got = queries()["op12_best_fit"](spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    used = check_packing(got)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.add((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want
    assert used <= best_fit_decreasing([x.length for x in got], 4096) + 1


# ------------------------------------------------------------------ op13

def test_skip_list_reaches_every_rank():
    r = np.random.default_rng(5)
    for n in (0, 1, 5, 17, 400, 5000):
        widths = r.integers(1, 9, n).astype(np.int32)
        lanes = fill_in_middle.SkipList(widths)
        ends = np.concatenate(([0], np.cumsum(widths)))
        for rank in {0, n, *r.integers(0, n + 1, 60).tolist()}:
            assert lanes.offset(rank) == ends[rank]
        for units, points in lanes.lanes:
            assert units.sum() == n and points.sum() == widths.sum()
        if n == 5000:
            assert len(lanes.lanes) > 3 and len(lanes.lanes[1][0]) < n / 2


@pytest.mark.parametrize("unit", ["code point", "word", "line"])
def test_units_tile_the_text(unit):
    for t in ("", " ", "a", "one  two\nthree\n\n four ", "\n\n", "é🙂 é\nx", LONG):
        w = fill_in_middle.unit_widths(t, unit)
        assert w.sum() == len(t) and (w > 0).all()
    assert fill_in_middle.cut("one two three", 1, 2, "word") == (3, 4, 8)


@pytest.mark.parametrize("unit", ["code point", "word"])
def test_every_text_comes_back(spark, make_docs, unit):
    r = random.Random(6)
    texts = ["".join(r.choice("<PSM> ab\né🙂") for _ in range(r.randint(0, 12))) for _ in range(400)]
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(texts))]
    docs = make_docs(rows, clashes=True)
    f = fill_in_middle.transform(F.col("text"), F.col("doc_id"), unit=unit)
    got = docs.select("doc_id", "text", f.alias("f")).select(
        "doc_id", "text", "f.*", fill_in_middle.restore(F.col("f.output"), F.col("f.form")).alias("back")).collect()
    assert len(got) == len(rows) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        t = x.text or ""
        assert x.back == t
        h = [int(hashlib.sha256(f"1:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        assert x.form == ("plain" if plain else "spm" if h[3] % 100 < 20 else "psm")
        if unit == "code point":
            assert x.n == len(t)
            a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
            assert (x.prefix_chars, x.middle_chars) == ((None, None) if plain else (a, b - a))
            if not plain:
                pre, mid, suf = t[:a], t[a:b], t[b:]
                assert x.output == (f"<S>{suf}<P>{pre}<M>{mid}" if x.form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")
        elif not plain:
            assert t[:x.prefix_chars] + t[x.prefix_chars:][:x.middle_chars] == t[:x.prefix_chars + x.middle_chars]
    assert docs.where("false").select(f).count() == 0


def test_markers_that_could_arise_across_parts_are_refused():
    for bad in (("aa", "b", "c"), ("<a", "<a<", "<b"), ("x", "x", "y"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle.check_markers(bad)
