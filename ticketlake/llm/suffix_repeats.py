"""Substring dedup by prefix-partitioned suffix trees.

A window (`window` consecutive words) is repeated if its word sequence starts
anywhere else, in the same document or another. The suffixes of all texts are
split by variable-length prefixes into groups of bounded size. Of a group's suffix
tree only the nodes of depth `window` decide what is removed, so only they are
formed: a node is known by the hash of the window that leads to it, leaves with
one node are the repeated windows, and runs of them are the maximal repeats. Inner
nodes above that depth and the order of the suffixes below it are never built.

1. Copies: texts are collapsed to distinct ones by a map-side combined
   aggregation; the count says that a whole text repeats.
2. Anchors: of each window the least hash of its inner word groups is its
   anchor. Equal windows have equal anchors, so a window whose anchor occurs
   once in the corpus is a leaf without an inner node above it, and its suffix
   is left out. Anchors are about one in sixteen words; their count and the
   join back to their texts are ordinary Spark joins.
3. Prefixes: the remaining suffixes are counted by prefix bucket (65536 of them,
   a vector per task); buckets above `max(group_rows, rows / 10000)` are split
   by a prefix `step` words longer, until they fit or the prefix is the window.
4. Trees: rows (prefix, path, text, position) are partitioned and sorted by
   prefix and path; equal neighbours share a node of depth `window`. Equal
   windows of one batch are settled before the shuffle, which carries one
   representative of them, so a window of a hot group is a row a batch.

Words and windows are compared by 64-bit hashes of prefix and path together.

Defined cases: a null text has no words; texts shorter than the window keep
all; repeated ids and rows are separate occurrences; very long texts are read
whole, a chunk of words at a time; an empty table gives an empty result. Helper
columns take names that the table does not have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, fresh, written

by_value(__name__)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BUCKETS = 1 << 16
_CHUNK = 100_000        # words handled at once


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words met most recently."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of the n words from each position, by doubling; the
    last n - 1 positions have none."""
    out, done, power, cur = np.zeros(len(w), np.uint64), 0, int(base), w
    size = 1
    while size <= n:
        if n & size:        # append a block of `size` words
            shifted = np.zeros(len(w), np.uint64)
            shifted[: len(w) - done] = cur[done:]
            out = out * np.uint64(power) + shifted
            done += size
        nxt = np.zeros(len(w), np.uint64)
        if len(w) > size:
            nxt[: len(w) - size] = cur[: len(w) - size] * np.uint64(power) + cur[size:]
        cur, power, size = nxt, power * power % (1 << 64), size * 2
    return out[: max(0, len(w) - n + 1)]


def sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """`op` (minimum or maximum) over the n values from each position."""
    size, cur = 1, x
    while size * 2 <= n:
        cur = op(cur[: len(cur) - size], cur[size:])
        size *= 2
    extra = n - size
    return op(cur[: len(cur) - extra], cur[extra:]) if extra else cur


class Chunk:
    """Word hashes of some texts in one array, and which windows lie in one text."""

    def __init__(self, texts: list[list[bytes]], hashes: WordHashes, window: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        total = int(sizes.sum())
        self.w = np.fromiter((hashes[x] for t in texts for x in t), np.uint64, total)
        n = max(0, total - window + 1)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.text, self.pos = text[:n], np.arange(n) - self.first[text[:n]]
        self.inside = self.pos + window <= sizes[self.text]

    def anchors(self, window: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the word group at each position, anchor of each window)."""
        g = np.maximum(mix(rolling(self.w, inner, _BASE)), np.uint64(1))
        if len(self.w) < window:
            return g, np.zeros(0, np.uint64)
        low = sliding(g, window - inner + 1, np.minimum)
        return g, np.where(self.inside, low, np.uint64(0))


def _chunks(texts: Iterator[tuple], hashes: WordHashes, window: int) -> Iterator[tuple[list, Chunk]]:
    """Rows (tag, text) in chunks of about `_CHUNK` words; short texts are left out."""
    tags, held, size = [], [], 0
    for tag, text in texts:
        words = _words(text)
        if len(words) < window:
            continue
        tags.append(tag)
        held.append(words)
        size += len(words)
        if size >= _CHUNK:
            yield tags, Chunk(held, hashes, window)
            tags, held, size = [], [], 0
    if held:
        yield tags, Chunk(held, hashes, window)


def _anchor_rows(window: int, inner: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            for tags, c in _chunks(zip(pdf["k"].tolist(), pdf["text"]), hashes, window):
                g, low = c.anchors(window, inner)
                span = window - inner + 1
                # a group is an anchor where it is the least of some window around it
                padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
                top = sliding(padded, span, np.maximum)[: len(g)]
                at = np.flatnonzero(g[: len(top)] == top)
                text = np.searchsorted(c.first, at, side="right") - 1
                yield pd.DataFrame({"v": g[at].view(np.int64), "k": np.array(tags, np.int64)[text]})
    return rows


class Suffixes:
    """Suffix rows of the texts with shared anchors."""

    def __init__(self, window: int, inner: int, step: int):
        self.window, self.inner, self.step = window, inner, step
        self.lengths = [*range(step, window, step), window]

    def of(self, c: Chunk, shared: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(window starts, prefix hash by length, path hash) of a chunk's suffixes."""
        _, low = c.anchors(self.window, self.inner)
        at = np.flatnonzero(c.inside & np.isin(low, shared))
        return at, [mix(rolling(c.w, n, _BASE2))[at] for n in self.lengths], mix(rolling(c.w, self.window, _BASE) ^ _BASE2)[at]

    def chunks(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        hashes = WordHashes()
        for pdf in frames:
            texts = zip(zip(pdf["id"].tolist(), pdf["shared"]), pdf["text"])
            for tags, c in _chunks(texts, hashes, self.window):
                shared = np.unique(np.concatenate([np.asarray(s, np.int64) for _, s in tags])).view(np.uint64)
                at, prefixes, path = self.of(c, shared)
                if len(at):
                    yield np.array([t for t, _ in tags], np.int64)[c.text[at]], c.pos[at], prefixes, path


def bucket(prefix: np.ndarray) -> np.ndarray:
    return (prefix >> np.uint64(48)).astype(np.int64)


def prefix_level(prefixes: list[np.ndarray], large: list[np.ndarray]) -> np.ndarray:
    """Index of the first prefix length whose bucket is not too large."""
    level = np.zeros(len(prefixes[0]), np.int64)
    for k, big in enumerate(large):
        if k + 1 < len(prefixes) and len(big):
            at = np.flatnonzero(level == k)
            level[at[np.isin(bucket(prefixes[k][at]), big)]] = k + 1
    return level


def large_buckets(table: DataFrame, s: Suffixes, group_rows: int) -> list[np.ndarray]:
    """By prefix length, the buckets to be split; at most 10000 of each."""
    large: list[np.ndarray] = []
    for k in range(len(s.lengths) - 1):
        def count(frames: Iterator[pd.DataFrame], k: int = k, large: list = list(large)) -> Iterator[pd.DataFrame]:
            n = np.zeros(_BUCKETS, np.int64)
            for _, _, prefixes, path in s.chunks(frames):
                at = np.flatnonzero(prefix_level(prefixes, large) == k)
                at = at[np.unique(path[at], return_index=True)[1]]
                n += np.bincount(bucket(prefixes[k][at]), minlength=_BUCKETS)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"bucket": at, "n": n[at]})
        n = table.select("id", "text", "shared").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).toPandas()                                # at most 65536 rows
        big = n["bucket"][n["n"] > max(group_rows, int(n["n"].sum()) // 10_000)].to_numpy(np.int64)
        if not len(big):
            break
        large.append(big)
    return large


def _suffix_rows(s: Suffixes, large: list[np.ndarray]):
    """Rows (prefix, path, id, pos, stop). Windows that repeat inside a chunk
    are settled: their positions go as runs [pos, stop) with path null-like 0
    and prefix by text, and one representative (id -1) stands for them."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, pos, prefixes, path in s.chunks(frames):
            level = prefix_level(prefixes, large)
            prefix = np.choose(level, prefixes[: int(level.max()) + 1]) if len(level) else prefixes[0]
            order = np.lexsort((path, prefix))
            a, b = prefix[order], path[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            head = np.concatenate(([True], ~same))
            n = np.diff(np.append(np.flatnonzero(head), len(a)))
            many = np.repeat(n > 1, n)
            one, rep = order[~many], order[head & many]
            yield pd.DataFrame({
                "prefix": np.concatenate((prefix[one], prefix[rep])).view(np.int64),
                "path": np.concatenate((path[one], path[rep])).view(np.int64),
                "id": np.concatenate((ids[one], np.full(len(rep), -1))),
                "pos": np.concatenate((pos[one], np.zeros(len(rep), np.int64))), "stop": np.int64(0)})
            done = np.sort(order[many])
            if len(done):
                i, p = ids[done], pos[done]
                new = np.concatenate(([True], (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1)))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(i)) - 1
                yield pd.DataFrame({"prefix": i[first], "path": p[first], "id": i[first], "pos": p[first], "stop": p[last] + 1})
    return rows


def _tree_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by prefix and path: (id, pos, stop) of the leaves that
    share their node with a neighbour. Only the last row is carried over."""
    def leaves(pdf: pd.DataFrame, hit: np.ndarray, runs: np.ndarray) -> pd.DataFrame:
        ids, pos, stop = (pdf[c].to_numpy(np.int64) for c in ("id", "pos", "stop"))
        keep = (hit | runs) & (ids >= 0)
        return pd.DataFrame({"id": ids[keep], "pos": pos[keep], "stop": np.where(runs, stop, pos + 1)[keep]})

    held, held_hit = None, False
    for pdf in frames:
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat((held, pdf), ignore_index=True)
        pre, path = pdf["prefix"].to_numpy(np.int64), pdf["path"].to_numpy(np.int64)
        runs = pdf["stop"].to_numpy(np.int64) > 0
        same = np.zeros(len(pdf) + 1, bool)
        same[1:-1] = (pre[1:] == pre[:-1]) & (path[1:] == path[:-1]) & ~runs[1:] & ~runs[:-1]
        hit = same[1:] | same[:-1]
        hit[0] |= held_hit
        # the last row may share its node with the next frame's first
        held, held_hit = pdf.iloc[-1:], bool(hit[-1])
        yield leaves(pdf.iloc[:-1], hit[:-1], runs[:-1])
    if held is not None:
        yield leaves(held, np.array([held_hit]), held["stop"].to_numpy(np.int64) > 0)


def _keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def repeats(docs: DataFrame, *, text_col: str = "text", window: int = 35, inner: int = 5, step: int = 7,
            group_rows: int = 200_000) -> DataFrame:
    """(k, k2, text, copies, runs ARRAY<BIGINT>): every distinct text, known by
    two hashes, that shares an anchor, with its repeated windows as runs
    `start << 32 | stop` of window starts; a text with copies repeats whole."""
    k, k2 = _keys(F.col("text"))
    texts = docs.select(F.coalesce(col(text_col), F.lit("")).alias("text")).select("text", k.alias("k"), k2.alias("k2"))
    anchors = texts.select("k", "text").mapInPandas(_anchor_rows(window, inner), "v long, k long")
    anchors = written(anchors, "anchors")
    shared = written(anchors.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # anchors of over a ten-thousandth of the rows, at most 10000, are marked where their rows lie; the others are joined
    often = F.col("n") * 10_000 > anchors.count()
    marked = anchors.join(F.broadcast(shared.where(often).select("v", F.lit(True).alias("hot"))), "v", "left")
    marked = marked.where("hot").select("v", "k").unionByName(
        marked.where("hot IS NULL").select("v", "k").join(shared.where(~often).select("v"), "v"))
    marks = marked.groupBy("k").agg(F.collect_set("v").alias("shared"))
    distinct = texts.groupBy("k").agg(F.first(F.struct("k2", "text")).alias("x"), F.count(F.lit(1)).alias("copies"),
                                      F.min("k2").alias("lo"), F.max("k2").alias("hi"))
    table = distinct.join(marks, "k").select("k", "x.k2", "x.text", "copies", "shared", (F.col("lo") != F.col("hi")).alias("clash"))
    table = written(table.withColumn("id", F.monotonically_increasing_id()), "texts")
    if table.where("clash").limit(1).count():        # two texts with one first hash: told apart by both
        clash = table.where("clash").select("k", "shared")
        apart = (texts.join(clash, "k").groupBy("k", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"),
                                                              F.first("shared").alias("shared")))
        table = written(table.where("NOT clash").select("k", "k2", "text", "copies", "shared").unionByName(apart)
                             .withColumn("id", F.monotonically_increasing_id()), "texts")
    s = Suffixes(window, inner, step)
    large = large_buckets(table, s, group_rows)
    rows = table.select("id", "text", "shared").mapInPandas(
        _suffix_rows(s, large), "prefix long, path long, id long, pos long, stop long")
    leaves = (rows.repartition("prefix").sortWithinPartitions("prefix", "path")
                  .mapInPandas(_tree_leaves, "id long, pos long, stop long"))
    runs = leaves.groupBy("id").agg(F.collect_list(F.col("pos") * F.lit(1 << 32) + F.col("stop")).alias("runs"))
    return table.join(runs, "id", "left").select("k", "k2", "text", "copies", "runs")


def _covered(n_words: int, copies: int, runs, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    gone = np.zeros(n_words, bool)
    if n_words < window:
        return gone
    if copies > 1:
        return ~gone
    r = np.asarray(runs if runs is not None else [], np.int64)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, r >> 32, 1)
    np.add.at(edge, (r & 0xFFFFFFFF) + window - 1, -1)
    return edge.cumsum()[:-1] > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **kw) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document; the digest is
    that of the words kept, joined by one space."""
    @F.pandas_udf("n_removed long, kept_sha256 string")
    def cut(texts: pd.Series, copies: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, c, r in zip(texts, copies, runs):
            words = _words(text)
            gone = _covered(len(words), c, r, window)
            out.append((int(gone.sum()), _digest([w for w, g in zip(words, gone) if not g])))
        return pd.DataFrame(out, columns=["n_removed", "kept_sha256"])

    @F.pandas_udf("n_words long, whole string")
    def whole(texts: pd.Series) -> pd.DataFrame:
        # one text's words at a time: those of a whole batch would take hundreds of MB
        got = [(len(w), _digest(w)) for w in map(_words, texts)]
        return pd.DataFrame(got, columns=["n_words", "whole"])

    changed = repeats(docs, text_col=text_col, window=window, **kw)
    changed = written(changed.select("k", "k2", cut("text", "copies", "runs").alias("c")).select("k", "k2", "c.*")
                             .where("n_removed > 0"), "removals")
    k, k2 = _keys(F.col("_text"))
    mine = (docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("_text"))
                .select("id", k.alias("k"), k2.alias("k2"), whole(F.col("_text")).alias("w")).select("id", "k", "k2", "w.*"))
    return mine.join(changed, ["k", "k2"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = 35, **kw) -> DataFrame:
    """The documents with all their columns; texts that hold repeated windows
    become the words kept, joined by one space."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, copies: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, c, r in zip(texts, copies, runs):
            words = _words(text)
            gone = _covered(len(words), c, r, window)
            out.append(b" ".join(w for w, g in zip(words, gone) if not g).decode() if gone.any() else None)
        return pd.Series(out, dtype=object)

    k1, k2 = fresh(docs, "_k"), fresh(docs, "_k2")
    new = fresh(docs, "_new")
    changed = repeats(docs, text_col=text_col, window=window, **kw)
    changed = written(changed.select(F.col("k").alias(k1), F.col("k2").alias(k2), cut("text", "copies", "runs").alias(new))
                             .where(F.col(new).isNotNull()), "cut-texts")
    a, b = _keys(F.coalesce(col(text_col), F.lit("")))
    return (docs.withColumn(k1, a).withColumn(k2, b).join(changed, [k1, k2], "left")
                .select(*[F.coalesce(F.col(new), col(c)).alias(c) if c == text_col else col(c) for c in docs.columns]))
