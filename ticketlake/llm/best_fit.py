"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths are handled from the longest class down; a class k up to 8 holds the
lengths of which k fit into an empty sequence and k + 1 do not, the later ones
an octave each. In
each round the class's documents and the gaps that can take one are sorted by
size, descending, and dealt out by ranges. A sweep over its range lets every
document take the least gap before it, as closing brackets take opening ones;
what a range leaves open meets in the ranges after it at equal bracket depths
(the depth at a range's start is the sum over the ranges before it), so two
documents never claim one gap and the order of ranks decides. Gaps shrink by
what they took, and the round is repeated until no document fits. Documents
that are left open new sequences, k consecutive ones each, and the next class
follows.

A gap that can take several documents of a class stands in the sweep as that
many slots. Nothing is gathered: a task holds a range of small rows, and the
driver sees one row of counts a range and round. State is written to the shared
folder after every step, so a lost executor costs its tasks only.

Defined cases: a null or empty text is one token, the end mark, so a document is
never without a piece; repeated rows and null or equal ids are packed as rows of
their own; ties of length go by row. Only texts longer than a sequence are cut.
Very long texts are tokenized whole. Only the id and text
columns are read, so other columns may have any name; an empty table packs to an
empty one.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, written

by_value(__name__)

#: Words, and parts of words, whose ids a Python worker remembers, in each of
#: two generations (about 300 MB in all).
REMEMBERED = 250_000
REMEMBERED_PARTS = 600_000
#: The public tokenizer whose file the default path names.
TOKENIZER = "word_bpe_49k.json"


# ------------------------------------------------------------ tokenization

#: Parts of a plain word as the tokenizer splits it: contractions, runs of
#: letters, single digits, runs of other printable ASCII characters. Plain words
#: hold nothing else; for their letters (ASCII, Latin-1 and Latin Extended-A but
#: the dotted capital I) lower case and composition are the same everywhere.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable ones themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordIds(dict):
    """Ids of a text by its words. The tokenizer drops white space and never
    merges across it, so a text's ids are those of its words in order; a
    word's ids are kept as little-endian bytes while it is in use. Plain words
    are split here and their parts merged by the tokenizer's model, which is
    several times faster than the whole tokenizer; all others go through it."""

    def __init__(self, path: str | None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # a special token's name in a text is ordinary text
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.old, self.parts, self.old_parts = {}, {}, {}
        # the short way holds only for a tokenizer that splits and lowers as described; others take the long way
        probe = "Don't STOP1,2 (ÀÉîŒß) l'été o'clock'S x@y--z"
        self.short = b"".join(map(self._plain, probe.split())) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        low = word.lower()
        return b"".join(map(self._part, [low] if low.isalpha() else _PARTS.findall(low)))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(self.parts) > REMEMBERED_PARTS:
                self.parts, self.old_parts = {}, self.parts
            self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            ids = self._plain(text) if self.short and _PLAIN.fullmatch(text) else self._whole(text)
        if len(self) > REMEMBERED:                       # the words not met since become the older generation
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def word_ids(path: str | None) -> WordIds:
    """One per Python worker and path: a worker runs many tasks."""
    kept = sys.modules.setdefault("_ticketlake_tokenizers", types.ModuleType("_ticketlake_tokenizers")).__dict__
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pieces(docs: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
           path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document's tokens and its end
    mark, cut every `capacity` tokens; `with_ids` adds them as ARRAY<INT>.
    `path` names the tokenizer's file on the executors (default: the public
    word tokenizer's)."""
    rows = docs.select(col(id).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            ids = []
            for i, t in enumerate(batch.column(1)):
                whole = ids_of(t.as_py()) + end
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at:at + 4 * capacity]
                    for name, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()),
                    *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


# ----------------------------------------------------------------- packing

def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched openers, their closers, depth of every row) of a sequence of
    brackets. At one depth openers and closers alternate, so an opener's closer
    is the next row of its depth; a closer before any opener stays open."""
    depth = np.cumsum(np.where(opens, 1, -1)) + np.where(opens, 0, 1)
    order = np.argsort(depth, kind="stable")
    pair = opens[order[:-1]] & ~opens[order[1:]] & (depth[order[:-1]] == depth[order[1:]])
    return order[:-1][pair], order[1:][pair], depth


_SWEPT = "seq long, slot int, gap long, pid long, length long, depth long, part int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: matched rows have a sequence and a document; open rows have
    one of them and the depth within the range."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or t.num_rows == 0:
        return
    c = {n: t.column(n).to_numpy() for n in ("size", "kind", "key", "slot", "gap")}
    order = np.lexsort((c["slot"], c["key"], c["kind"], -c["size"]))
    c = {n: v[order] for n, v in c.items()}
    doc = c["kind"] == 1
    o, z, depth = brackets(~doc)
    left = np.ones(len(doc), bool)
    left[o] = left[z] = False
    rest = np.flatnonzero(left)
    no, is_doc = np.zeros(len(o), bool), doc[rest]
    col_ = lambda name, a, b, gone_a, gone_b, kind: pa.array(
        np.concatenate((c[name][a], c[name][b])), kind, mask=np.concatenate((gone_a, gone_b)))
    yield pa.RecordBatch.from_arrays([
        col_("key", o, rest, no, is_doc, pa.int64()), col_("slot", o, rest, no, is_doc, pa.int32()),
        col_("gap", o, rest, no, is_doc, pa.int64()), col_("key", z, rest, no, ~is_doc, pa.int64()),
        col_("size", z, rest, no, ~is_doc, pa.int64()),
        pa.array(np.concatenate((np.zeros(len(o), np.int64), depth[rest])), pa.int64(), mask=np.concatenate((~no, np.zeros(len(rest), bool)))),
        pa.array(np.full(len(o) + len(rest), part, np.int32))], names=["seq", "slot", "gap", "pid", "length", "depth", "part"])


def _match(docs: DataFrame, gaps: DataFrame, unit: int, least: int, tasks: int = 8) -> tuple[DataFrame, dict, dict[int, int]]:
    """One round: (rows of seq, slot, gap, pid, length, rank, part; counts;
    tokens left by range). A row has a sequence's slot and the document that it
    took, a slot alone, or a document alone with its rank from the longest on."""
    wide = F.greatest(F.lit(1), F.floor(F.col("gap") / unit)).cast("int")
    slots = (gaps.where(F.col("gap") >= least).withColumn("m", wide)
                 .select("seq", "gap", "m", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("slot"))
                 .select(F.when(F.col("slot") < F.col("m"), F.lit(unit)).otherwise(F.col("gap") - (F.col("m") - 1) * unit).cast("long").alias("size"),
                         F.lit(0).alias("kind"), F.col("seq").alias("key"), "slot", "gap"))
    both = slots.unionByName(docs.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("key"),
                                         F.lit(0).alias("slot"), F.lit(0).cast("long").alias("gap")))
    # neighbouring ranges are swept by one task, as many as make it worth one
    ranges = both.repartitionByRange(F.desc("size"), "kind", "key", "slot").coalesce(tasks)
    swept = written(ranges.mapInArrow(_sweep, _SWEPT), "swept")
    taken, left = F.col("pid").isNotNull() & F.col("seq").isNotNull(), F.when(F.col("seq").isNull(), F.col("length"))
    counts = [F.count(F.when(taken, 1)).alias("taken"), F.count(left).alias("left"), F.sum(left).alias("tokens"),
              F.min(left).alias("least"), F.max(left).alias("most"), F.max("slot").alias("slots"),
              F.count(F.when(taken & (F.col("gap") - F.col("length") >= least), 1)).alias("fit")]

    def by_part(rows: DataFrame) -> list:        # a row a range
        return sorted(rows.groupBy("part").agg(F.count(F.when(F.col("pid").isNull(), 1)).alias("open"), *counts).collect())

    per = by_part(swept)
    start, at, seen_open, across = [], 0, False, False
    for r in per:
        start.append((r["part"], at))
        across |= seen_open and r["left"] > 0
        seen_open |= r["open"] > 0
        at += r["open"] - r["left"]
    cols = ["seq", "slot", "gap", "pid", "length", "part"]
    base = swept.sparkSession.createDataFrame(start, "part int, base long")
    rest = (swept.where("depth IS NOT NULL").join(F.broadcast(base), "part")
                 .select(*cols, (F.col("depth") + F.col("base")).alias("depth")))
    if across:
        # openers and closers of one depth alternate over the ranges too; within a range the closer comes first
        w = Window.partitionBy("depth").orderBy("part", F.col("pid").isNull())
        free = F.col("pid").isNull()
        takes = free & F.lead("pid").over(w).isNotNull()
        rest = (rest.withColumns({"next": F.when(takes, F.lead("pid").over(w)), "next_length": F.when(takes, F.lead("length").over(w)),
                                  "gone": ~free & F.coalesce(F.lag("seq").over(w).isNotNull(), F.lit(False))})
                    .where("NOT gone")
                    .select("seq", "slot", "gap", F.coalesce("pid", "next").alias("pid"),
                            F.coalesce("length", "next_length").alias("length"), "part", "depth"))
    out = (swept.where("depth IS NULL").select(*cols, F.lit(None).cast("long").alias("rank"))
                .unionByName(rest.select(*cols, F.when(F.col("seq").isNull(), -F.col("depth")).alias("rank"))))
    if across:
        out = written(out, "matched")
        per = by_part(out)
    total = {f: [r[f] for r in per if r[f] is not None] for f in ("taken", "left", "least", "most", "slots", "fit")}
    now = {f: sum(v) if f in ("taken", "left", "fit") else (min if f == "least" else max)(v, default=0) for f, v in total.items()}
    return out, now, {r["part"]: r["tokens"] or 0 for r in per}


def _opened(left: DataFrame, n: int, k: int, capacity: int, most: int, tokens: dict[int, int]) -> DataFrame:
    """New sequences for `n` documents that no gap can take, in the order of
    their ranks: as many at a time as fit of the longest, or, where that fills
    sequences better (from class 9 on), by the tokens before them, so that all
    of a sequence's documents start within `capacity` less the longest one."""
    at_once = capacity // most
    if k <= 8 or at_once * sum(tokens.values()) >= (capacity - most) * n:
        left = left.withColumn("run", F.floor(F.col("rank") / at_once))
    else:
        start, at = [], 0
        for part in sorted(tokens):
            start.append((part, at))
            at += tokens[part]
        before = F.sum("length").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        base = left.sparkSession.createDataFrame(start, "part int, base long")
        left = left.join(F.broadcast(base), "part").withColumn(
            "run", F.floor((F.col("base") + F.coalesce(before, F.lit(0))) / (capacity - most + 1)))
    run = Window.partitionBy("run").orderBy("rank")
    whole = F.sum("length").over(Window.partitionBy("run"))
    return left.select(F.first("pid").over(run).alias("seq"), "pid",
                       F.coalesce(F.sum("length").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
                       F.when(F.row_number().over(run) == 1, F.lit(capacity) - whole).alias("gap"))


def pack(items: DataFrame, capacity: int = 4096, worth: int = 8, task_rows: int = 100_000) -> DataFrame:
    """(pid, sequence_id, offset) for rows (pid, length): pid is a unique long,
    lengths are 1 to `capacity`. A sequence's number is the pid of the piece
    that opened it; its pieces follow each other without a gap from 0. A class
    is swept again while gaps that took a document and could take another one
    number at least a `worth`-th of the documents left. A sweep or a step's table
    takes a task for every `task_rows` documents and gaps."""
    j = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    k_of = F.when(j <= 8, j).when(j < 16, F.lit(9)).otherwise(F.expr(f"shiftleft(1L, cast(floor(log2({capacity} div length)) as int))"))
    # classes are 1 to 9 and powers of two, so the driver sees about log2(capacity) rows
    sizes = {r["k"]: (r["n"], r["a"]) for r in items.groupBy(k_of.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("length").alias("a")).collect()}
    classes = sorted(k for k in sizes if k > 1)
    alone = items.where(F.col("length") > capacity // 2)
    # a step's rows: placements (pid), and once a sequence the gap that it is left with
    none = F.lit(None).cast("long")
    steps = [alone.select(F.col("pid").alias("seq"), "pid", F.lit(0).cast("long").alias("offset"),
                          (F.lit(capacity) - F.col("length")).alias("gap"))]

    def keep(rows: DataFrame, unit: int, tasks: int) -> tuple[int, int]:
        """Writes a step; returns the slots of `unit` that its gaps hold, and the gaps."""
        seen = Observation()
        rows = rows.coalesce(tasks).observe(seen, F.sum(F.floor(F.col("gap") / unit)).alias("slots"), F.count_if(F.col("gap") > 0).alias("gaps"))
        steps.append(written(rows, "packed"))
        return seen.get["slots"] or 0, seen.get["gaps"]

    total = sum(n for n, _ in sizes.values())
    room, n_gaps = keep(steps.pop(), capacity // classes[0], 1 + total // task_rows) if classes else (0, 0)
    while classes:
        k, shortest = classes[0], min(sizes[x][1] for x in classes)
        unit, everything = capacity // k, sum(sizes[x][0] for x in classes)
        if room >= everything:              # a slot of this class for each document left: one sweep takes them all
            docs, n, least, classes = items.where(F.col("length") <= unit), everything, shortest, []
        else:
            low = capacity // (k + 1 if k <= 8 else 16 if k == 9 else 2 * k)
            docs, (n, least), classes = items.where((F.col("length") > low) & (F.col("length") <= unit)), sizes[k], classes[1:]
        while n:
            gaps = steps[-1].where("gap > 0").select("seq", "gap")
            tasks = 1 + (n + n_gaps) // task_rows
            got, now, tokens = _match(docs, gaps, unit, least, tasks)
            slot = F.col("slot")
            of_seq, used = Window.partitionBy("seq"), got.where("seq IS NOT NULL")
            rows = gaps.where(F.col("gap") < least).select("seq", none.alias("pid"), none.alias("offset"), "gap")
            if now["slots"] <= 1:
                rows = rows.unionByName(used.select("seq", "pid", F.when(F.col("pid").isNotNull(), F.lit(capacity) - F.col("gap")).alias("offset"),
                                                    (F.col("gap") - F.coalesce("length", F.lit(0))).alias("gap")))
            else:
                before = F.sum("length").over(of_seq.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
                rows = rows.unionByName(used.select(
                    "seq", "pid", F.when(F.col("pid").isNotNull(), F.lit(capacity) - F.col("gap") + F.coalesce(before, F.lit(0))).alias("offset"),
                    F.when(slot == 1, F.col("gap") - F.coalesce(F.sum("length").over(of_seq), F.lit(0))).alias("gap")))
            docs, n, was = got.where("seq IS NULL"), now["left"], n
            if n and (n == was or now["fit"] * worth < n):
                rows, n = rows.unionByName(_opened(docs, n, k, capacity, now["most"], tokens)), 0
            room, n_gaps = keep(rows, unit if n or not classes else capacity // classes[0], tasks)
            least = now["least"] or least
    return reduce(DataFrame.unionByName, [s.where("pid IS NOT NULL").select("pid", F.col("seq").alias("sequence_id"), "offset") for s in steps])


def pack_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
                   path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of
    every piece of every document."""
    cut = pieces(docs, id=id, text=text, capacity=capacity, end_id=end_id, path=path, with_ids=with_ids)
    cut = written(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut.select("pid", "length"), capacity), "pid").drop("pid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the training sequences of a packing with
    ids, each of at most the capacity's tokens."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["ids"])).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))
