"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are lower-cased (A-Z) and freed of punctuation. Seeds are pairs of
neighbouring words. An alignment that reaches the score keeps at least
`least_hits` of its item's pairs, wherever the edits stand, so no fewer than
that can be hit; half of that number, the pairs that most documents hold, are
left out of the seeds, and the other half must be hit on diagonals no further
apart than the alignment's gaps allow. Items too short for such a bound are
seeded by their words. The bound holds for any choice of the pairs left out:
how often a pair occurs decides the cost only, not what is found.

A first pass over all documents counts in how many of them each gram of the
benchmark occurs (counted inside the task, summed by a grouped aggregation); a
second joins passages to items by their seeds, and aligns every passage that
could reach the score; no candidate is capped. The passes are map-only; the
benchmark goes to the tasks in blocks of at most `block_chars` characters, one
pair of passes for each.

Score: best local alignment (match 2, mismatch -1, gap -1 a word) over twice
the item's words: 1 for a verbatim copy, about 0.7 with a fifth of the words
replaced.

Defined cases: null or empty texts match nothing; items with fewer than `n`
words match nothing; items and documents that repeat give a
row each; null ids are passed on; very long texts are searched whole; of equal
alignments of an item the first counts; an empty table on either side gives an
empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, fresh

by_value(__name__)

_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\"'()[]{}<>|*#%$&", b"abcdefghijklmnopqrstuvwxyz" + b" " * 22)


def clean_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class Grams:
    """The n-grams of a block of items, findable in a document's words."""

    def __init__(self, texts: list[str | None], n: int):
        self.n, words = n, [clean_words(t) for t in texts]
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64) for ws in words]
        item, pos, keys = [], [], []
        for i, a in enumerate(self.items):
            for p in range(len(a) - n + 1):
                item.append(i)
                pos.append(p)
                keys.append(tuple(a[p: p + n]))
        ids: dict[tuple, int] = {}
        gram = np.array([ids.setdefault(k, len(ids)) for k in keys], np.int64)
        # gram ids are ranks of packed keys, packed two words at a time
        self.level: list[np.ndarray] = []
        grams = np.array(list(ids), np.int64).reshape(-1, n)
        self.size = len(grams)
        self.gram, self.item, self.pos = gram, np.array(item, np.int64), np.array(pos, np.int64)
        self._pack(grams)
        order = np.argsort(gram, kind="stable")
        self.by_gram = order
        self.first = np.searchsorted(gram[order], np.arange(self.size + 1))

    def _pack(self, grams: np.ndarray) -> None:
        base = len(self.vocab) + 1
        key = grams[:, 0] if self.size else np.zeros(0, np.int64)
        for i in range(1, self.n):
            packed = key * base + grams[:, i] if self.size else key
            self.level.append(np.unique(packed))
            key = np.searchsorted(self.level[-1], packed)
        self.rank = np.full(self.size, -1, np.int64)
        if self.size:
            self.rank[key] = np.arange(self.size)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary number of each word, -1 for words of no item."""
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, gram) of each occurrence of a gram in the word numbers."""
        n = self.n
        if len(a) < n or not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = a >= 0
        at = known[: len(a) - n + 1].copy()
        for i in range(1, n):
            at &= known[i: len(a) - n + 1 + i]
        pos = np.flatnonzero(at)
        key, base = a[pos], len(self.vocab) + 1
        for i in range(1, n):
            level = self.level[i - 1]
            packed = key * base + a[pos + i]
            j = np.minimum(np.searchsorted(level, packed), len(level) - 1)
            ok = level[j] == packed
            pos, key = pos[ok], j[ok]
        return pos, self.rank[key]


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word-number arrays and its end in
    `doc` (exclusive). Gaps cost one a word, so a row's horizontal gaps are a
    running maximum."""
    j = np.arange(1, len(doc) + 1)
    h, best, end = np.zeros(len(doc) + 1, np.int64), 0, 0
    for w in item:
        x = np.maximum(h[:-1] + np.where(doc == w, 2, -1), h[1:] - 1)
        x = np.maximum(np.maximum.accumulate(x + j) - j, 0)
        m = int(x.argmax())
        if x[m] > best:
            best, end = int(x[m]), m + 1
        h[1:] = x
    return best, end


def least_hits(m: int, n: int, min_score: float) -> int:
    """How many of an item's `n`-grams (pairs or words) every alignment that
    reaches the score keeps. M matches and E edits score at most 2 M - E; they
    keep M - 1 - E pairs or more, and M is at most the item's m words."""
    need = int(np.ceil(min_score * 2 * m - 1e-9))
    return need - m - 1 if n == 2 else (need + 1) // 2


class Seeds(NamedTuple):
    """Which gram rows are seeds; for each item the seeds that a passage must
    hit and the most by which their diagonals differ."""
    row: np.ndarray
    hits: np.ndarray
    shift: np.ndarray


def seeds(g: Grams, df: np.ndarray, min_score: float) -> Seeds:
    """Each item's grams without the most common ones that may be left out."""
    size = np.array([len(x) for x in g.items], np.int64)
    least = np.array([max(1, least_hits(m, g.n, min_score)) for m in size.tolist()], np.int64)
    row, drop = np.ones(len(g.gram), bool), least // 2
    first = np.searchsorted(g.item, np.arange(len(size) + 1))
    for lo, hi, k in zip(first[:-1], first[1:], drop):
        row[lo + np.argsort(-df[g.gram[lo:hi]], kind="stable")[:k]] = False
    return Seeds(row, least - drop, 2 * size - np.ceil(min_score * 2 * size - 1e-9).astype(np.int64))


def find_items(g: Grams, seed: Seeds, words: list[bytes], min_score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the best alignment of each item
    that reaches `min_score` in the document."""
    a = g.ids(words)
    pos, gram = g.hits(a)
    if not len(pos):
        return []
    n_rows = g.first[gram + 1] - g.first[gram]
    row = g.by_gram[np.repeat(g.first[gram] - np.concatenate(([0], np.cumsum(n_rows)[:-1])), n_rows) + np.arange(n_rows.sum())]
    keep = seed.row[row]
    row, at = row[keep], np.repeat(pos, n_rows)[keep]
    item, start = g.item[row], at - g.pos[row]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    # passages: enough seeds on diagonals close enough, with room for an alignment through them
    i = np.arange(len(item))
    j = i + seed.hits[item] - 1
    i, j = i[j < len(item)], j[j < len(item)]
    near = (item[i] == item[j]) & (start[j] - start[i] <= seed.shift[item[i]])
    i, j = i[near], j[near]
    if not len(i):
        return []
    item, lefts = item[i], start[j] - seed.shift[item[i]]
    rights = start[i] + seed.shift[item] + np.array([len(g.items[k]) for k in item.tolist()], np.int64)
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (lefts[1:] > rights[:-1])))
    out: dict[int, tuple[float, int, int]] = {}
    firsts = np.flatnonzero(new)
    for lo, hi in zip(firsts, np.append(firsts[1:], len(item))):
        it = int(item[lo])
        m = len(g.items[it])
        left, right = max(0, int(lefts[lo])), min(len(a), int(rights[hi - 1]))
        need = min_score * 2 * m
        for at in range(left, right, 40 * m):        # long runs of seeds are aligned in overlapping stretches
            part = a[at: min(right, at + 42 * m)]
            if 2 * int(np.isin(part, g.items[it]).sum()) < need:
                continue
            score, end = align(g.items[it], part)
            if score >= need and score / (2 * m) > out.get(it, (0.0,))[0]:
                _, back = align(g.items[it][::-1], part[:end][::-1])
                out[it] = (score / (2 * m), at + end - back, at + end)
    return [(it, *v) for it, v in sorted(out.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[pd.DataFrame]:
    b = benchmark.select(col(id_col).alias("id"), col(text_col).alias("text"))
    chars = b.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    n = -(-chars // block_chars) or 1
    for i in range(n):
        pdf = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).toPandas()
        if len(pdf):
            yield pdf.reset_index(drop=True)


def gram_counts(docs: DataFrame, text_col: str, grams: Grams) -> np.ndarray:
    """Number of documents that hold each gram, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, df = shared.value, None
        for pdf in frames:
            df = np.zeros(g.size, np.int64) if df is None else df
            for t in pdf["_text"]:
                df[np.unique(g.hits(g.ids(clean_words(t)))[1])] += 1
        if df is not None:
            at = np.flatnonzero(df)
            yield pd.DataFrame({"gram": at, "df": df[at]})

    got = (docs.select(col(text_col).alias("_text")).mapInPandas(count, "gram long, df long")
               .groupBy("gram").agg(F.sum("df").alias("df")).toPandas())      # at most a row per gram of the block
    out = np.zeros(grams.size, np.int64)
    out[got["gram"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return out


def _matcher(docs: DataFrame, pdf: pd.DataFrame, text_col: str, n: int, min_score: float):
    size = [len(clean_words(t)) for t in pdf["text"]]
    parts = []
    for k in (1, 2):        # items whose pairs may all be edited are seeded by words
        mine = [t if m >= n and (least_hits(m, 2, min_score) > 0) == (k == 2) else None for t, m in zip(pdf["text"], size)]
        if any(mine):
            g = Grams(mine, k)
            parts.append((g, seeds(g, gram_counts(docs, text_col, g), min_score)))
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("array<struct<item:int,score:double,first_word:int,end_word:int>>")
    def match(texts: pd.Series) -> pd.Series:
        words = map(clean_words, texts)
        return pd.Series([[{"item": i, "score": s, "first_word": a, "end_word": b}
                           for g, seed in shared.value for i, s, a, b in find_items(g, seed, w, min_score)] for w in words], dtype=object)
    return match


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", n: int = 3, min_score: float = 0.6,
                   block_chars: int = 4_000_000) -> DataFrame:
    """(id, item, score, first_word, end_word): every document that holds a
    verbatim, paraphrased or edited copy of a benchmark item."""
    spark, out = docs.sparkSession, None
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    for pdf in _blocks(benchmark, item_col, item_text_col, block_chars):
        match = _matcher(docs, pdf, text_col, n, min_score)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(pdf["id"].astype(object).where(pdf["id"].notna(), None))],
                                      f"item int, name {item_type.simpleString()}")
        got = (docs.select(col(id_col).alias("id"), F.explode(match(col(text_col))).alias("x")).select("id", "x.*")
                   .join(F.broadcast(names), "item")                     # a row per item of the block
                   .select("id", F.col("name").alias("item"), "score", "first_word", "end_word"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], f"id {id_type.simpleString()}, item {item_type.simpleString()}, score double, "
                                        "first_word int, end_word int")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", n: int = 3, min_score: float = 0.6,
                      block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no copy of any item, with their columns."""
    out = docs
    for pdf in _blocks(benchmark, item_col, item_text_col, block_chars):
        f = fresh(docs, "_leaks")
        match: Column = _matcher(docs, pdf, text_col, n, min_score)(col(text_col))
        out = out.withColumn(f, F.size(match)).where(col(f) == 0).drop(f)
    return out
