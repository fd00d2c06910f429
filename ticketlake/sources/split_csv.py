"""Quoted multi-line CSV read by many tasks.

Spark's `multiLine` reader gives a whole file to one task, as a line break may
stand inside a quoted field. Here the text is split as any text file is. A first
pass counts the quotes of every split; whether a split begins inside a field is
the parity of the quotes before it in its file. With that, a second pass joins
each split's lines to records on its own; only the pieces of records that cross a
split's end (at most two a split) are shuffled and joined. Records are parsed
with the schema by `from_csv`.

The driver holds a row a split (what it holds for any scan).

Defined cases: doubled quotes count as two, so they do not change the parity; an
empty file gives no rows; each file's first record is its header, and empty lines
between records are skipped, as the built-in reader does; records that do not fit
the schema have nulls; carriage returns before a line break are dropped at a
record's end and kept inside a field.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pieces(start_inside: dict[tuple[str, int], bool]):
    """Joins a task's lines to records. A row is a whole record (kind 0), the
    end of a record of an earlier split (1), a record that goes on in a later
    split (2, the header: 4), or a split wholly inside a field (3). A header
    that is whole is left out."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, kind, header = None, [], False, 0, False
        out: list[tuple[str, int, int, str]] = []

        def flush() -> None:
            nonlocal held
            if now is not None and held:
                # lines that are left at a split's end belong to a record that goes on
                out.append((*now, 3 if kind == 1 else 4 if header else 2, "\n".join(held)))
            held = []

        for batch in batches:
            for file, at, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, at) != now:
                    flush()
                    now = (file, at)
                    inside = start_inside.get(now, False)
                    kind, header = (1 if inside else 0), at == 0
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    if not header:
                        out.append((*now, kind, "\n".join(held)))
                    held, kind, header = [], 0, False
            yield _batch(out)
            out = []
        flush()
        yield _batch(out)
    return fn


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "at", "kind", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): every record of the files, headers and empty lines left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    # a row a split
    per = sorted(lines.groupBy("file", "at").agg(F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).alias("q")).collect())
    inside, was, odd = {}, None, False
    for r in per:
        odd = False if r["file"] != was else odd
        was, inside[r["file"], r["at"]] = r["file"], odd
        odd ^= r["q"] % 2 == 1
    got = lines.mapInArrow(_pieces(inside), "file string, at long, kind int, text string")
    # a record goes on from the piece that opens it up to the next piece of kind 1
    by_file = Window.partitionBy("file").orderBy("at", "kind")
    torn = got.where("kind > 0").withColumn("record", F.sum(F.col("kind").isin(2, 4).cast("int")).over(by_file))
    pieces = F.array_sort(F.collect_list(F.struct("at", "kind", "text")))
    joined = torn.groupBy("file", "record").agg(pieces.alias("x")).where(F.get("x", F.lit(0))["kind"] != 4).select(
        "file", F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text"))
    every = got.where("kind = 0").select("file", "text").unionByName(joined)
    return every.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of `tables.read_csv`, read by as many tasks as there are splits."""
    row = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                     {"quote": '"', "escape": '"', "lineSep": "\u0000"})
    return csv_records(spark, path).select(row.alias("r")).select("r.*")
