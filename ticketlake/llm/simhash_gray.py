"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64-bit majority sums of XXH64 shingle hashes, computed in Arrow
batches. Links: equal fingerprints are one node (a map-side combined
aggregation), so copies never meet as pairs. Distinct fingerprints are dealt by
pigeonhole: two that differ in at most `max_bits` bits agree on all but
`max_bits` of `max_bits + 2` pieces, so each choice of two agreeing pieces is a
key. Inside a task the fingerprints of a key are put in Gray order and indexed
as a tree: a node holds the bits that all its members share, without those its
parent already holds, so a query adds up its differences on the way down and
drops a whole group as soon as they exceed `max_bits`. A group of one key can
hold at most 2^(64 - key bits) fingerprints; keys with more than
`max(20000, rows / 10000)` are dealt once more by a piece of the remaining bits
(by pigeonhole again, so no link is lost), and their number is at most 10000.
A task returns a spanning forest of its links, not the links.

Defined cases: null or empty texts have fingerprint zero and link like any
other; fewer words than the shingle length are one shingle; repeated ids and
rows are rows of one class; a null id never is a class's name unless the class
has no other; very long texts are read whole; a bit set in exactly half of the
hashes is 0; an empty table gives an empty result. Helper columns take names that
the table does not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, components, fresh, written

by_value(__name__)

_CHUNK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if more than half of the shingle hashes have it set."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stop = (ends[shingle - 1:] - 1).tolist()
    n, sums = len(start), np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(start[lo: lo + _CHUNK], stop[lo: lo + _CHUNK])),
                        np.uint64, min(_CHUNK, n - lo))
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(sums[b]) > n)


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed BIGINT."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))
    return fp(text)


# --------------------------------------------------------------- index kernel

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def build_levels(fps: np.ndarray, fan: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits, mask) of the nodes of each level, leaves first, for codes in
    Gray order: `mask` marks the bits that all members share."""
    levels = [(fps, np.full(len(fps), ~np.uint64(0), np.uint64))]
    while len(levels[-1][0]) > fan:
        bits, mask = levels[-1]
        cut = np.arange(0, len(bits), fan)
        same = ~(np.bitwise_or.reduceat(bits, cut) ^ np.bitwise_and.reduceat(bits, cut))
        levels.append((bits[cut], np.bitwise_and.reduceat(mask, cut) & same))
    # what a parent's mask holds is factored out of its children
    for k in range(len(levels) - 1):
        bits, mask = levels[k]
        levels[k] = (bits, mask & ~np.repeat(levels[k + 1][1], fan)[: len(mask)])
    return levels


def near_pairs(fps: np.ndarray, max_bits: int, fan: int = 8, chunk: int = 2048,
               most: int = 3_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, member) within `max_bits` bits, query < member, for
    distinct codes in Gray order; a batch for every `chunk` queries at most.
    Queries whose frontier exceeds `most` nodes are taken in halves."""
    levels = build_levels(fps, fan)
    top = len(levels[-1][0])
    todo = [(lo, min(lo + chunk, len(fps))) for lo in range(0, len(fps), chunk)][::-1]
    while todo:
        lo, hi = todo.pop()
        q, node = np.repeat(np.arange(lo, hi), top), np.tile(np.arange(top), hi - lo)
        diff = np.zeros(len(q), np.uint8)
        for k in range(len(levels) - 1, -1, -1):
            bits, mask = levels[k]
            diff = diff + np.bitwise_count((fps[q] ^ bits[node]) & mask[node])
            ok = diff <= max_bits
            if k:       # a pair is needed once: groups that end before the query are left out
                ok &= (node + 1) * fan ** k > q
            q, node, diff = q[ok], node[ok], diff[ok]
            if not k:
                ok = node > q
                yield q[ok], node[ok]
            elif len(q) * fan > most and hi - lo > 1:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                break
            else:
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                q, diff = np.repeat(q, fan), np.repeat(diff, fan)
                ok = node < len(levels[k - 1][0])
                q, node, diff = q[ok], node[ok], diff[ok]


def join_forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs into `parent` (least member labels), vectorised."""
    while len(a):
        ra, rb = parent[a], parent[b]
        ne = ra != rb
        a, b, ra, rb = a[ne], b[ne], ra[ne], rb[ne]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) codes of a spanning forest of the links among `fps`."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    parent = np.arange(len(fps))
    for a, b in near_pairs(fps, max_bits):
        parent = join_forest(parent, a, b)
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[moved], fps[parent[moved]]


# ------------------------------------------------------------------ operator

def _pieces(width: int, n: int) -> list[int]:
    """Masks of `n` runs of bits that split the lowest `width` bits."""
    at = [width * i // n for i in range(n + 1)]
    return [sum(1 << b for b in range(at[i], at[i + 1])) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, fp: str, max_bits: int = 2, batch: int = 30_000) -> DataFrame:
    """(a, b) BIGINT: links of a spanning forest per index group over the
    distinct codes; their transitive closure is that of all links."""
    pieces = _pieces(64, max_bits + 2)
    masks = [a | b for a, b in combinations(pieces, 2)]
    fpc = col(fp)
    dealt = codes.select(fpc.alias("fp"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.lit(0).alias("t2"), fpc.bitwiseAND(F.lit(_signed(m))).alias("k"))
        for i, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.t2", "x.k")
    rows = codes.count() * len(masks)
    limit = max(20_000, rows // 10_000)
    heavy = dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    heavy = written(heavy.select("t", "k", F.lit(True).alias("hot")), "hot-keys")     # at most 10000 rows
    if heavy.limit(1).count():
        rest = []
        for m in masks:                       # the bits outside the key, in max_bits + 1 pieces
            free = [b for b in range(64) if not m >> b & 1]
            cut = [len(free) * i // (max_bits + 1) for i in range(max_bits + 2)]
            rest.append([sum(1 << b for b in free[cut[i]: cut[i + 1]]) for i in range(max_bits + 1)])
        more = F.array(*[F.element_at(F.array(*[
            F.struct(F.lit(j + 1).alias("t2"), fpc.bitwiseAND(F.lit(_signed(masks[i] | rest[i][j]))).alias("k"))
            for i in range(len(masks))]), F.col("t") + 1) for j in range(max_bits + 1)])
        dealt = (dealt.join(F.broadcast(heavy), ["t", "k"], "left").withColumnRenamed("fp", fp)
                 .withColumn("x", F.when(F.col("hot"), more)
                             .otherwise(F.array(F.struct(F.lit(0).alias("t2"), F.col("k").alias("k")))))
                 .select(col(fp).alias("fp"), "t", F.explode("x").alias("x")).select("fp", "t", "x.t2", "x.k"))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in frames:
            held.append(pdf)
            size += len(pdf)
            if size < batch:
                continue
            # whole groups go; the last one may continue in the next frame
            pdf = pd.concat(held, ignore_index=True)
            last = pdf.iloc[-1]
            tail = ((pdf["k"] == last["k"]) & (pdf["t"] == last["t"]) & (pdf["t2"] == last["t2"])).to_numpy()
            if not tail.all():
                a, b = forest(np.unique(pdf["fp"].to_numpy()[~tail].view(np.uint64)), max_bits)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            held, size = [pdf[tail]], int(tail.sum())
        if held:
            a, b = forest(np.unique(pd.concat(held)["fp"].to_numpy().view(np.uint64)), max_bits)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (dealt.repartition("t", "t2", "k").sortWithinPartitions("t", "t2", "k")
                 .select("t", "t2", "k", "fp").mapInPandas(index, "a long, b long"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int,
             max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, root, least id) of every fingerprint."""
    fps = written(docs.select(col(id_col).alias("id"), fingerprint(col(text_col), shingle, seed).alias("fp")), "fingerprints")
    codes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    roots = components(links(codes, "fp", max_bits), "a", "b")
    named = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        codes["fp"], F.coalesce("root", codes["fp"]).alias("root"), "least")
    return fps, named


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
            max_bits: int = 2) -> DataFrame:
    """(id, fingerprint BIGINT, component): one row per document with the
    smallest id of its class of linked documents."""
    fps, named = _classes(docs, id_col, text_col, shingle, seed, max_bits)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return (fps.join(named.join(least, "root").select("fp", "component"), "fp")
               .select("id", F.col("fp").alias("fingerprint"), "component"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
             max_bits: int = 2) -> DataFrame:
    """One document of each class, that with the smallest id, with all its
    columns. A class without ids keeps one of the documents with its smallest
    fingerprint; of rows that repeat the kept id and fingerprint one stays."""
    fps, named = _classes(docs, id_col, text_col, shingle, seed, max_bits)
    # a fingerprint's least id is known, so no row is joined to its class
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("x"))
    best = best.select(F.col("x.least").alias("id"), F.col("x.fp").alias("fp"))
    # an id of one row names its document; ids of several rows are told apart by fingerprint
    often = fps.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    best = written(best.join(often.withColumn("often", F.lit(True)), best["id"].eqNullSafe(often["id"]), "left")
                       .select(best["id"], "fp", F.coalesce("often", F.lit(False)).alias("often")), "kept-ids")
    i, f = fresh(docs, "_kept_id"), fresh(docs, "_kept_fp")
    g = fresh(docs.withColumn(f, F.lit(0)), "_own_fp")
    is_kept = col(id_col).eqNullSafe(F.col(i))
    out = docs.join(best.where("NOT often").select(F.col("id").alias(i)), is_kept, "left_semi")
    if best.where("often").limit(1).count():
        some = best.where("often").select(F.col("id").alias(i), F.col("fp").alias(f))
        many = docs.join(some.select(i).distinct(), is_kept, "left_semi").withColumn(
            g, fingerprint(col(text_col), shingle, seed))
        many = many.join(some, is_kept & (F.col(g) == F.col(f)), "left_semi")
        out = out.unionByName(many.dropDuplicates([id_col, g]).drop(g))
    return out
