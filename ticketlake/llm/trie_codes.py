"""Product codes for vectors, assigned by tries over the distinct parts.

Vectors are cut into equal consecutive parts of integer components, and every
part position has a codebook of a few entries. A task sorts the distinct parts
of its rows lexicographically and walks the trie that their dimension prefixes
form, depth first: a node adds its own dimension's squared differences to the
distance vector (one number an entry) that it shares with all parts below.
Subtrees of a bounded number of leaves are expanded level by level in numpy; a
leaf's argmin is the part's code, and leaves weighted by their multiplicity are
summed an entry, which is all that leaves a task in training.

No shuffle of vectors: the vectors are read once a round and once at the end.
The driver holds the codebooks (parts x entries x width numbers, fixed by the
parameters and the width) and the first `entries` rows.

Defined cases: rows whose vector is null or has a null, NaN or infinite
component are dropped. The width is that of the first kept row; rows of other
widths keep null code and error, and a width that the parts do not divide is
filled up with zeros. Components beyond 2**62 are held there; distances are
exact (Python integers where 64 bits do not suffice) and sums beyond 2**63 - 1
are held there. Fewer rows than entries give fewer entries. Rows with equal ids
are ordered by their vectors; null ids come last. Null groups count as one.
Only the named columns are read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, written

by_value(__name__)

#: Components that a task gathers before it builds its tries (32 MB).
CHUNK_VALUES = 4 << 20
#: Leaves of a subtree that is expanded as a whole.
SUBTREE = 8192
FAR = 1 << 62
LONGEST = (1 << 63) - 1


@dataclass
class Codebooks:
    """`books[p]` is an (entries x part width) integer array; `width` the
    vectors' own width before it is filled up."""
    books: list[np.ndarray]
    width: int

    def sha256(self) -> str:
        wide = self.books[0].shape[1] if self.books else 0
        flat = (str(int(x)) for p, b in enumerate(self.books) for row in b for i, x in enumerate(row)
                if p * wide + i < self.width)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held at 2**62, as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -float(FAR), float(FAR)).astype(np.int64)


def exact_type(peak: int, dims: int):
    """64-bit integers where squared distances over `dims` fit, else Python's."""
    return np.int64 if (2 * peak) ** 2 * max(1, dims) < LONGEST else object


def trie_leaves(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct parts, the dimension where each leaf leaves the path
    of the leaf before it, leaf of each row)."""
    n, w = parts.shape
    if n == 0 or w == 0:
        return parts[:min(n, 1)], np.zeros(min(n, 1), np.int64), np.zeros(n, np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    differs = rows[1:] != rows[:-1]
    new = np.concatenate(([True], differs.any(axis=1)))
    leaf = np.empty(n, np.int64)
    leaf[order] = np.cumsum(new) - 1
    return rows[new], np.concatenate(([0], differs.argmax(axis=1)[new[1:]])), leaf


def walk(leaves: np.ndarray, splits: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every leaf of a trie, depth first; ties go
    to the lower entry. A stack frame is a node's leaf range, its depth and the
    distances accumulated along its path."""
    n, w = leaves.shape
    entry, far = np.zeros(n, np.int64), np.zeros(n, book.dtype)
    stack = [(0, n, 0, np.zeros((1, len(book)), book.dtype))] if n else []
    while stack:
        lo, hi, depth, acc = stack.pop()
        if hi - lo > SUBTREE and depth < w:             # its children, the first on top
            at = lo + np.flatnonzero(splits[lo:hi] <= depth)
            at = at if len(at) and at[0] == lo else np.concatenate(([lo], at))
            ends = np.append(at[1:], hi)
            for a, b in zip(at[::-1], ends[::-1]):
                stack.append((int(a), int(b), depth + 1, acc + (book[:, depth] - leaves[a, depth]) ** 2))
            continue
        node = np.zeros(hi - lo, np.int64)              # the whole subtree: one row of distances a node
        for d in range(depth, w):
            new = splits[lo:hi] <= d
            new[0] = True
            at = np.flatnonzero(new)
            acc = acc[node[at]] + (leaves[lo:hi][at, d][:, None] - book[None, :, d]) ** 2
            node = np.cumsum(new) - 1
        best = acc.argmin(axis=1)
        entry[lo:hi], far[lo:hi] = best[node], acc[np.arange(len(best)), best][node]
    return entry, far


def assign(vectors: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every part position: (leaves, weights, entry of a leaf, distance of
    a leaf, leaf of a row)."""
    w = books[0].shape[1]
    for p, book in enumerate(books):
        leaves, splits, leaf = trie_leaves(vectors[:, p * w:(p + 1) * w])
        peak = max(int(np.abs(book).max(initial=0)), int(np.abs(leaves).max(initial=0)))
        kind = exact_type(peak, w)
        entry, far = walk(leaves.astype(kind), splits, book.astype(kind))
        yield leaves, np.bincount(leaf, minlength=len(leaves)), entry, far, leaf


def _chunks(batches: Iterator[pa.RecordBatch], width: int, wide: int, scale: int):
    """(rows of other columns, integer vectors) of at most about CHUNK_VALUES
    components; rows of another width come with no vectors."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, CHUNK_VALUES // max(1, width))):
            piece = batch.slice(at, max(1, CHUNK_VALUES // max(1, width)))
            held.append(piece)
            n += piece.num_rows * max(1, width)
            if n >= CHUNK_VALUES:
                yield _split(held, width, wide, scale)
                held, n = [], 0
    if held:
        yield _split(held, width, wide, scale)


def _split(held: list[pa.RecordBatch], width: int, wide: int, scale: int):
    t = pa.Table.from_batches(held).combine_chunks()
    vec = t["vec"].combine_chunks()
    vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
    sizes = np.diff(vec.offsets.to_numpy())
    fits = sizes == width
    flat = vec.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    own = np.zeros((int(fits.sum()), wide), np.int64)
    own[:, :width] = to_integers(flat.reshape(len(own), width), scale)
    return t, fits, own


def fit_step(rows: DataFrame, cb: Codebooks, scale: int) -> Codebooks:
    """One round: every part to its nearest entry, entries to the floor of
    their parts' means; unused entries stay."""
    parts, wide = len(cb.books), cb.books[0].shape[1]
    entries = len(cb.books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), object)
        s = np.zeros((parts, entries, wide), object)
        for _, _, own in _chunks(batches, cb.width, parts * wide, scale):
            for p, (leaves, weight, entry, _, _) in enumerate(assign(own, cb.books)):
                peak = int(np.abs(leaves).max(initial=0)) * max(1, int(weight.sum()))
                kind = np.int64 if peak < LONGEST else object
                total = np.zeros((entries, wide), kind)
                np.add.at(total, entry, leaves.astype(kind) * weight.astype(kind)[:, None])
                s[p] += total.astype(object)
                n[p] += np.bincount(entry, weights=weight, minlength=entries).astype(np.int64).astype(object)
        at = [(p, e) for p in range(parts) for e in range(entries) if n[p, e]]
        if at:
            dec = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p * entries + e for p, e in at for _ in range(wide + 1)], pa.int32()),
                 pa.array([i for _ in at for i in range(-1, wide)], pa.int32()),
                 pa.array([Decimal(int(v)) for p, e in at for v in (n[p, e], *s[p, e])], dec)], names=["cell", "i", "s"])

    got = rows.select("vec").mapInArrow(sums, "cell int, i int, s decimal(38,0)")
    # bounded by parts x entries x (width + 1), whatever the number of rows
    books = [b.astype(object).copy() for b in cb.books]
    total = {(r["cell"], r["i"]): int(r["s"]) for r in got.groupBy("cell", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    for (cell, i), v in total.items():
        if i >= 0:
            books[cell // entries][cell % entries, i] = v // total[cell, -1]
    return Codebooks([b.astype(np.int64) for b in books], cb.width)


def prepare(df: DataFrame, id: str, vec: str, group: str | None) -> DataFrame:
    """(id, vec, grp): the rows whose vector is whole and finite."""
    rows = df.select(col(id).alias("id"), col(vec).cast("array<double>").alias("vec"),
                     (col(group) if group else F.lit(None).cast("string")).alias("grp"))
    return rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def fit(df: DataFrame, *, id: str = "vec_id", vec: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2,
        scale: int = 256) -> Codebooks | None:
    """Codebooks that start as the parts of the `entries` first rows by id and
    are refined `rounds` times; none for a table without a whole vector."""
    rows = prepare(df, id, vec, None)
    first = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
    if not first:
        return None
    width = len(first[0]["vec"])
    wide = math.ceil(width / parts)
    start = np.zeros((0, parts * wide), np.int64)
    for r in first:
        if len(r["vec"]) == width:
            own = np.zeros((1, parts * wide), np.int64)
            own[0, :width] = to_integers(np.array(r["vec"], np.float64), scale)
            start = np.concatenate((start, own))
    cb = Codebooks([start[:, p * wide:(p + 1) * wide] for p in range(parts)], width)
    for _ in range(rounds if width else 0):
        cb = fit_step(rows, cb, scale)
    return cb


def encode(df: DataFrame, cb: Codebooks, *, id: str = "vec_id", vec: str = "embedding", group: str | None = None,
           scale: int = 256) -> DataFrame:
    """(id, grp, code, error): two hex digits a part (more where there are
    over 256 entries), and the squared distance summed over the parts."""
    rows = prepare(df, id, vec, group)
    parts, wide = len(cb.books), cb.books[0].shape[1]
    digits = max(2, len(f"{max(1, len(cb.books[0])) - 1:x}"))
    names = np.array([f"{e:0{digits}x}" for e in range(len(cb.books[0]))], object)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, fits, own in _chunks(batches, cb.width, parts * wide, scale):
            text = np.full(len(own), "", object)
            error = np.zeros(len(own), object)
            for _, _, entry, far, leaf in assign(own, cb.books):
                text = text + names[entry][leaf]
                error = error + far[leaf].astype(object)
            code, err = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits], err[fits] = text, [min(int(x), LONGEST) for x in error]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("id", "grp")),
                                           pa.array(code, pa.string()), pa.array(err, pa.int64())], names=["id", "grp", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(codes, f"id {types['id']}, grp {types['grp']}, code string, error long")


def with_group_error(coded: DataFrame, hot: int = 1000) -> DataFrame:
    """Adds group_error, the errors of the row's group (nulls together).
    Groups above rows / hot, which are at most `hot`, go to every task; the
    rows of all others are joined by their group."""
    total = coded.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    total = written(total.select("grp", "n", F.when(F.col("s") > LONGEST, F.lit(LONGEST)).otherwise(F.col("s").cast("long")).alias("group_error")), "totals")
    n = total.agg(F.sum("n").alias("n")).first()["n"] or 0
    big = total.where(F.col("n") * hot > n).select("grp", "group_error", F.lit(True).alias("is_hot"))
    rest = total.where(F.col("n") * hot <= n).select("grp", "group_error")

    def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = right.withColumnRenamed("grp", "grp2")
        return left.join(r, F.col("grp").eqNullSafe(F.col("grp2")), how).drop("grp2")

    marked = on(coded, F.broadcast(big), "left")
    return (marked.where("is_hot").drop("is_hot")
                  .unionByName(on(marked.where("is_hot IS NULL").drop("is_hot", "group_error"), rest, "inner")))


def compress(df: DataFrame, *, id: str = "vec_id", vec: str = "embedding", group: str = "label", parts: int = 16,
             entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id, code, error, group_error, codebooks_sha256) of every whole vector."""
    cb = fit(df, id=id, vec=vec, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if cb is None:
        rows = prepare(df, id, vec, group)
        return rows.where("false").select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                          F.lit(0).cast("long").alias("group_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(encode(df, cb, id=id, vec=vec, group=group, scale=scale), "codes")
    return with_group_error(coded).select("id", "code", "error", "group_error", F.lit(cb.sha256()).alias("codebooks_sha256"))
