"""LM scoring by masked pseudo-likelihood.

A window network reads `SIDE` tokens on either side of every token: the sum of
position-wise embeddings, a tanh layer and a softmax over tokens. A document's
score is the sum of the conditional log-probabilities of all its words.

Vocabulary: every word of the corpus, counted inside the tasks and summed by a
grouped aggregation. The most frequent words are tokens of their own; all others
share the tokens of hash classes, and P(word | context) = P(class | context) *
P(word | class). The second factor is the word's count in the class less
`DISCOUNT`; what the discounts free goes to unseen words, byte by byte over an
even alphabet. The counts of the `known` most frequent words go to the tasks;
rarer words are looked up by a join on their 64-bit hash.

Training covers every token of every document: each task trains its
own copy, from the same start, on its documents, and the copies are averaged by
their token counts in a grouped aggregation over parameter positions, so what
is gathered grows with the input and only one model reaches the driver. The
start's output bias holds the corpus's unigram log-probabilities.

Defined cases: null and empty texts have no tokens, score 0 and a null mean;
repeated ids and rows are scored alike; very long texts are scored whole; words
of equal counts are ordered by themselves; an empty table gives an empty result.
Only the named columns are read, so others may have any name.

Limits: the network names 96 words; on the test documents these are 27 % of the
tokens, and all others see the context only through their hash class, so that
the context is worth 0.08 nats a word there. One round of averaging makes scores
depend on the layout of the files (0.09 nats a word between 1 and 32 partitions).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, written

by_value(__name__)

SIDE = 2
DISCOUNT = 0.5          # taken off every word's count for the unseen words
_CHUNK = 200_000        # tokens encoded at once
_BATCH = 4096           # tokens of a training step


class Vocabulary:
    """Token numbers: frequent words, then hash classes; `size` is padding."""

    def __init__(self, words: list[str], classes: int):
        self.words = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
        self.classes, self.size = classes, len(words) + classes

    def encoder(self) -> dict:
        return _Encoder(self.words, self.classes)


class _Encoder(dict):
    def __init__(self, words: dict[bytes, int], classes: int):
        super().__init__(words)
        self.fixed, self.classes = words, classes

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 300_000:
            self.clear()
            self.update(self.fixed)
        h = xxhash.xxh64_intdigest(word, 42)
        # the remainder of the signed hash, as the aggregation over words takes it
        t = self[word] = len(self.fixed) + (h - (1 << 64) if h >> 63 else h) % self.classes
        return t


class Known(NamedTuple):
    """Frequent words outside the top, with token and log P(word | class)."""
    words: list[bytes]
    tokens: np.ndarray
    logs: np.ndarray


class _Lexicon(dict):
    """Numbers of words, into arrays of tokens and log P(word | class); 0 is
    padding. Words that are not known get a log of 0 and their hash."""

    def __init__(self, vocab: Vocabulary, known: Known):
        super().__init__()
        self.fixed = dict(zip([*vocab.words, *known.words], range(1, len(vocab.words) + len(known.words) + 1)))
        self.first_rare, self.classes, self.top = len(self.fixed) + 1, vocab.classes, len(vocab.words)
        self.base = np.concatenate(([vocab.size], np.arange(self.top), known.tokens)).astype(np.int32)
        self.logs = np.concatenate((np.zeros(1 + self.top), known.logs))
        self.clear_rare()

    def clear_rare(self) -> None:
        self.clear()
        self.update(self.fixed)
        self.hashes: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = xxhash.xxh64_intdigest(word, 42)
        self.hashes.append(h - (1 << 64) if h >> 63 else h)
        self.sizes.append(len(word))
        n = self[word] = len(self) + 1
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by number, and of the rare words hashes and bytes."""
        h = np.array(self.hashes, np.int64)
        return np.concatenate((self.base, (self.top + h % self.classes).astype(np.int32))), self.logs, h, np.array(self.sizes, np.int32)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def chunks(texts, encoder: dict, pad: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, tokens with SIDE paddings around every text, position of
    each token) for texts of about `_CHUNK` tokens together."""
    ids, parts, size = [], [], 0
    edge = np.full(SIDE, pad, np.int32)

    def pack() -> tuple[list[int], np.ndarray, np.ndarray]:
        x = np.concatenate([edge, *[y for p in parts for y in (p, edge)]])
        return ids, x, np.flatnonzero(x != pad)

    for i, t in enumerate(texts):
        w = _words(t)
        ids.append(i)
        parts.append(np.fromiter(map(encoder.__getitem__, w), np.int32, len(w)))
        size += len(w)
        if size >= _CHUNK:
            yield pack()
            ids, parts, size = [], [], 0
    if ids:
        yield pack()


class Network:
    """emb (2 SIDE, V + 1, d), hid (d), out (d, V), bias (V)."""

    def __init__(self, size: int, dim: int, bias: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 0.1, (2 * SIDE, size + 1, dim)).astype(np.float32), np.zeros(dim, np.float32),
                  r.normal(0, 0.05, (dim, size)).astype(np.float32), bias.astype(np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[at: at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    @staticmethod
    def offsets() -> list[int]:
        return [*range(-SIDE, 0), *range(1, SIDE + 1)]

    def train(self, x: np.ndarray, at: np.ndarray, state: list, rate: float) -> None:
        """Adam steps over the tokens at the positions, in order."""
        emb, hid, out, bias = self.p
        small = np.int16 if emb.shape[1] < 1 << 15 else np.int32
        for lo in range(0, len(at), _BATCH):
            i = at[lo: lo + _BATCH]
            n, y = len(i), x[i]
            ctx = [x[i + o] for o in self.offsets()]
            h = np.tanh(sum(emb[k].take(c, 0) for k, c in enumerate(ctx)) + hid)
            z = h @ out
            z += bias
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            z[np.arange(n), y] -= 1
            z /= n
            dh = (z @ out.T) * (1 - h * h)
            g = [np.zeros_like(emb), dh.sum(0), h.T @ z, z.sum(0)]
            for k, c in enumerate(ctx):         # sums of rows by token, as sums over the sorted batch
                c = c.astype(small)
                order = np.argsort(c, kind="stable")        # 16 bits: sorted by radix, in the same order
                c = c[order]
                first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
                g[0][k][c[first]] = np.add.reduceat(dh.take(order, 0), first, 0)
            state[0] += 1
            t = state[0]
            for j, gj in enumerate(g):
                m, v = state[1][j], state[2][j]
                m += 0.1 * (gj - m)
                v += 0.01 * (gj * gj - v)
                self.p[j] -= (rate * min(1.0, t / 20) / (1 - 0.9 ** t)) * m / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)

    def fresh_state(self) -> list:
        return [0, [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the two left and of the two right embeddings, by token pair."""
        emb, hid = self.p[0], self.p[1]
        left = emb[0][:, None, :] + emb[1][None, :, :] + hid
        right = emb[2][:, None, :] + emb[3][None, :, :]
        return left.reshape(-1, len(hid)), right.reshape(-1, len(hid))

    def log_probs(self, x: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Conditional log-probability of the token at each position."""
        _, _, out, bias = self.p
        n, (left, right), lp = self.p[0].shape[1], tables, np.empty(len(at))
        for lo in range(0, len(at), _BATCH):
            i = at[lo: lo + _BATCH]
            h = left.take(x[i - 2] * n + x[i - 1], 0)
            h += right.take(x[i + 1] * n + x[i + 2], 0)
            z = np.tanh(h, out=h) @ out
            z += bias
            want = z[np.arange(len(i)), x[i]]
            np.exp(z, out=z)            # logits are small: biases are log-probabilities, |h| <= 1
            lp[lo: lo + _BATCH] = want - np.log(z.sum(1))
        return lp


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over every text, combined inside the tasks first."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in c], "n": list(c.values())})

        for pdf in frames:
            for t in pdf["_text"]:
                c.update(_words(t))
                if len(c) > 200_000:
                    yield out()
                    c.clear()
        if c:
            yield out()
    return docs.select(col(text_col).alias("_text")).mapInPandas(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


class Model(NamedTuple):
    """The network over tokens, and the words within their classes: `counts`
    (word, n) of the corpus, tokens and different words of each class."""
    vocab: Vocabulary
    net: Network
    counts: DataFrame
    total: np.ndarray
    distinct: np.ndarray
    known: Known


def _known(counts: DataFrame, vocab: Vocabulary, total: np.ndarray, known: int) -> Known:
    # words above the least count that `known` words reach: no more rows than these are gathered
    top, by_count = len(vocab.words), counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    least = by_count["n"][by_count["words"].cumsum() <= top + known].min()      # NaN, and no words, if even the first are more
    got = (counts.where(F.col("n").cast("double") >= F.lit(float(least))) if least == least else counts.limit(0)).select(
        "word", "n", F.pmod(F.xxhash64("word"), F.lit(vocab.classes)).alias("c")).toPandas()
    got["word"] = [w.encode("utf-8", "surrogatepass") for w in got["word"]]
    got = got[~got["word"].isin(list(vocab.words))]
    c = got["c"].to_numpy(np.int64)
    return Known(list(got["word"]), top + c, np.log((got["n"].to_numpy(float) - DISCOUNT) / total[c]))


def fit(docs: DataFrame, *, text_col: str = "text", top_words: int = 96, classes: int = 32, dim: int = 16,
        rate: float = 0.004, known: int = 200_000) -> Model:
    """The averaged network over all tokens of all documents, and all words."""
    counts = written(word_counts(docs, text_col), "word-counts")
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(top_words).collect()]
    vocab = Vocabulary(words, classes)
    index = F.coalesce(F.array_position(F.lit(words) if words else F.array().cast("array<string>"), F.col("word")), F.lit(0))
    token = F.when(index > 0, index - 1).otherwise(len(words) + F.pmod(F.xxhash64("word"), F.lit(classes)))
    freq, distinct = np.ones(vocab.size), np.zeros(vocab.size)
    for r in counts.groupBy(token.alias("t")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():      # at most a row a token
        freq[r["t"]] += r["n"]
        distinct[r["t"]] = r["d"]
    start = Network(vocab.size, dim, np.log(freq / freq.sum()))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen = vocab.encoder(), 0
        net = Network(vocab.size, dim, start.p[3]).load(start.flat())
        state = net.fresh_state()
        for pdf in frames:
            for _, x, at in chunks(pdf["_text"], enc, vocab.size):
                net.train(x, at, state, rate)
                seen += len(at)
        if seen:
            yield pd.DataFrame({"w": [net.flat().tolist()], "n": [seen]})

    got = (docs.select(col(text_col).alias("_text")).mapInPandas(train, "w array<float>, n long")
               .select("n", F.posexplode("w").alias("at", "x"))
               .groupBy("at").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x")).toPandas())
    if len(got):        # a row a parameter
        start.load(got.sort_values("at")["x"].to_numpy())
    total = freq[len(words):] - 1
    return Model(vocab, start, counts, total, distinct[len(words):], _known(counts, vocab, total, known))


def _rare_log(model: Model) -> Column:
    """log P(word | class) by hash `h`, bytes `b` and count `n` (null: unseen)."""
    at = (F.pmod("h", F.lit(model.vocab.classes)) + 1).cast("int")
    of = lambda a: F.element_at(F.lit([float(x) for x in a]), at)
    seen = model.total > 0
    # an even alphabet of 256 bytes and an end; the hash puts one in `classes` of all byte strings into a class
    freed = np.log(np.where(seen, DISCOUNT * model.distinct / np.where(seen, model.total, 1), 1) * model.vocab.classes)
    return F.when(F.col("n").isNotNull(), F.log((F.col("n") - DISCOUNT) / of(model.total))).otherwise(
        of(freed) - (F.col("b") + 1) * F.lit(float(np.log(257))))


def score_rows(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every document."""
    spark, size = docs.sparkSession, model.vocab.size
    shared = spark.sparkContext.broadcast((model.vocab, model.net, model.known))

    @F.pandas_udf("n_tokens long, log_prob double, h array<long>, b array<int>")
    def pll(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab, net, known = shared.value
        lex, tables = _Lexicon(vocab, known), net.pairs()
        for texts in batches:
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            hs, bs = [], []
            for ids, x, at in chunks(texts, lex, 0):
                tokens, logs, hashes, sizes = lex.arrays()
                lp = net.log_probs(tokens[x], at, tables)
                y = x[at]
                rare = y >= lex.first_rare
                lp[~rare] += logs[y[~rare]]
                # a text's number is that of the paddings before its tokens
                row = (np.cumsum(x == 0)[at] // SIDE) - 1
                n[ids] = np.bincount(row, minlength=len(ids))
                total[ids] = np.bincount(row, lp, minlength=len(ids))
                which, cut = y[rare] - lex.first_rare, np.searchsorted(row[rare], np.arange(1, len(ids)))
                hs += np.split(hashes[which], cut)
                bs += np.split(sizes[which], cut)
                if len(lex.hashes) > 200_000:
                    lex.clear_rare()
            yield pd.DataFrame({"n_tokens": n, "log_prob": total, "h": hs, "b": bs})

    base = written(docs.select(col(id_col).alias("id"), pll(col(text_col)).alias("s"))
                       .select(F.monotonically_increasing_id().alias("row"), "id", "s.*"), "word-scores")
    rare = base.select("row", F.explode(F.arrays_zip("h", "b")).alias("x")).select("row", "x.h", "x.b")
    sums = (rare.join(model.counts.select(F.xxhash64("word").alias("h"), "n"), "h", "left")
                .groupBy("row").agg(F.sum(_rare_log(model)).alias("rest")))
    whole = F.col("log_prob") + F.coalesce("rest", F.lit(0.0))
    return (base.drop("h", "b").join(sums, "row", "left")
                .select("id", "n_tokens", whole.alias("log_prob"),
                        F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_prob")))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every document under the
    network trained on all of them."""
    return score_rows(docs, fit(docs, text_col=text_col, **kw), id_col=id_col, text_col=text_col)
