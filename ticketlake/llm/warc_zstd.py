"""WARC archives compressed with a dictionary.

A task gathers records and writes an archive of about `archive_bytes` of
payload: a Zstandard dictionary is trained on pieces spread over the archive's
records (at most `sample_bytes` of them), put into a leading skippable frame, and
every record is compressed on its own with it, so a record can be read alone. An
archive that holds too little for a dictionary of its own gets one trained on a
sample of the whole table (none only where the table itself holds under 8 KB). Records
whose payload equals that of an earlier page are written as revisits.

Equal payloads are found by SHA-1 and length with a map-side combined grouped
minimum, so copies never meet in one task. Archives are written under a
temporary name and moved into place; the name is given by the partition, the
archive's number and the attempt, and only archives listed by the task that
succeeded are read: lost executors and repeated tasks leave no double records.
Only a folder that driver and executors share is used, through the file system
that its address names.

Defined cases: a null html is an empty payload; a null url is an empty target;
a payload of at least `min_bytes` is revisited, smaller ones are always
responses; the response of equal payloads is the row with the smallest page_id,
of repeated page_ids one of them by url; a null page_id comes last; an empty
table gives an empty result; very long payloads are written whole. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, shared_folder, written

by_value(__name__)

#: FIXED VALUES: the magic number of the skippable frame that carries a
#: dictionary, and of a raw Zstandard frame.
DICT_FRAME_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only, with the length of the
    payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(h["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    h["payload"] = rest[:n]
    return h


def pieces_of(records: list[bytes], sample_bytes: int, piece: int = 4096) -> list[bytes]:
    """Pieces spread evenly over all records, of at most `sample_bytes` in all:
    as many of a long record as its share of the bytes gives, so that a few
    large records are as good to train on as many small ones."""
    total = sum(map(len, records))
    every = max(piece, -(-total // max(1, sample_bytes // piece)))      # bytes of the archive for each piece
    out, ahead = [], 0
    for r in records:
        at = ahead
        while at < len(r):
            out.append(r[at:at + piece])
            at += every
        ahead = at - len(r)
    return out


def train_dictionary(records: list[bytes], dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from pieces of the records; empty if they hold too little
    to train one (8 pieces, 8 KB)."""
    import zstandard
    sample = pieces_of(records, sample_bytes)
    if len(sample) < 8:                 # few short records: smaller pieces
        sample = pieces_of(records, sample_bytes, max(64, sum(map(len, records)) // 16))
    size = sum(map(len, sample))
    if len(sample) < 8 or size < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(dict_bytes, size // 4), sample, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""          # e.g. all records alike: nothing to learn


def archive_bytes_of(records: list[bytes], dict_bytes: int, sample_bytes: int, level: int, shared: bytes = b"") -> bytes:
    """The archive: a skippable frame with the dictionary, then a frame a
    record. `shared` is the dictionary of archives too small for their own."""
    import zstandard
    raw = train_dictionary(records, dict_bytes, sample_bytes) or shared
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None,
                                 write_content_size=True)
    return b"".join([struct.pack("<II", DICT_FRAME_MAGIC, len(raw)), raw, *map(c.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    import zstandard
    at, d = 0, None
    if data[:4] == struct.pack("<I", DICT_FRAME_MAGIC):
        n = struct.unpack("<I", data[4:8])[0]
        d = zstandard.ZstdCompressionDict(data[8: 8 + n]) if n else None
        at = 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=d)
    while at < len(data):
        if data[at: at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts = reader.decompressobj(), []
        while not one.eof:
            piece = data[at: at + 8192]
            if not piece:
                raise ValueError("the last record is cut off")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _store(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder under another name, then move it."""
    from pyarrow import fs
    # Spark writes local addresses with one slash
    system, path = fs.FileSystem.from_uri(folder.removeprefix("file:") if folder.startswith("file:/") else folder)
    system.create_dir(path, recursive=True)
    draft = posixpath.join(path, f"_draft-{uuid.uuid4().hex}")
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, posixpath.join(path, name))


def first_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                min_bytes: int = 0) -> DataFrame:
    """(id, url, html, refers_to, revisit) for every page."""
    p = pages.select(col(id_col).alias("id"), F.coalesce(col(url_col).cast("string"), F.lit("")).alias("url"),
                     F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html").cast("long"))
    me = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    first = (p.where(F.col("size") >= min_bytes).groupBy("sha", "size")
              .agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # all rows of a copied payload but the first revisit it
    first = written(first.select("sha", "size", "first"), "copied-payloads")
    got = p.join(first, ["sha", "size"], "left")
    is_first = F.col("first").isNotNull() & F.col("first").eqNullSafe(me)
    ties = written(got.where(is_first).groupBy("sha", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select("sha", "size"), "tied-firsts")
    if ties.limit(1).count():       # rows that repeat the first in id and url: one of them is the response
        tied = got.where(is_first).join(ties, ["sha", "size"], "left_semi")
        one = tied.groupBy("sha", "size", "id", "url").agg(F.first("html").alias("html"), F.first("first").alias("first"),
                                                          F.count(F.lit(1)).alias("n"))
        one = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        rest = got.join(ties.withColumn("tied", F.lit(True)), ["sha", "size"], "left").where(
            F.col("tied").isNull() | ~F.coalesce(is_first, F.lit(False)))
        got = rest.select("id", "url", "html", "first", F.lit(1).alias("i")).unionByName(
            one.select("id", "url", "html", "first", "i"))
    else:
        got = got.withColumn("i", F.lit(1))
    return got.select("id", "url", "html", F.col("first.id").alias("refers_to"),
                      (F.col("first").isNotNull() & (~F.col("first").eqNullSafe(me) | (F.col("i") > 1))).alias("revisit"))


def shared_dictionary(pages: DataFrame, payload_col: str, dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary of the whole table, for archives that are too small for one
    of their own: from the first 4 KB of the payloads with the least hashes, at
    most `sample_bytes` in all."""
    p = F.substring(col(payload_col).cast("string"), 1, 4096).alias("p")
    some = pages.where(F.length(col(payload_col).cast("string")) > 0).select(p).orderBy(F.xxhash64("p")).limit(max(8, sample_bytes // 16_384))
    return train_dictionary([r["p"].encode("utf-8", "surrogatepass") for r in some.collect()], dict_bytes, sample_bytes)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = 16 << 20,
                   dict_bytes: int = 64 << 10, sample_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Write the archives and return (file, n_records, raw_bytes, file_bytes)."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            data = archive_bytes_of(held, dict_bytes, sample_bytes, level, shared)
            _store(folder, name, data)
            return pd.DataFrame({"file": [name], "n_records": [len(held)], "raw_bytes": [size], "file_bytes": [len(data)]})

        for pdf in frames:
            for pid, url, html, ref, revisit in zip(pdf["id"], pdf["url"], pdf["html"], pdf["ref"], pdf["revisit"]):
                payload = html.encode("utf-8", "surrogatepass")
                raw = record_bytes(pid, url.replace("\r", "%0D").replace("\n", "%0A"), payload, payload_digest(payload),
                                   ref if revisit else None)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    got = first_pages(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shared = shared_dictionary(pages, payload_col, dict_bytes, sample_bytes)
    # the list is kept: what it names was written by the attempts that succeeded
    return written(got.select(text("id").alias("id"), "url", "html", text("refers_to").alias("ref"), "revisit")
                      .mapInPandas(write, "file string, n_records long, raw_bytes long, file_bytes long"), "archive-list")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload) of every record of the listed archives; a response's digest and
    length are recomputed from its payload and must be those of its headers; a
    revisit's payload is empty, its digest and length are those of the full
    payload, from its headers."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["content"]:
                rows, size = [], 0
                for raw in read_archive(data):
                    h = parse_record(raw)
                    ref, digest, length = h.get("WARC-Refers-To"), h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        stated, digest, length = (digest, length), payload_digest(h["payload"]), len(h["payload"])
                        if stated != (digest, length):
                            raise ValueError(f"{h['WARC-Record-ID']}: payload read {digest}, {length} bytes; the headers say {stated}")
                    rows.append((h["WARC-Record-ID"][10:-1], h["WARC-Target-URI"], h["WARC-Type"], ref[10:-1] if ref else None,
                                 digest, length, h["payload"]))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    spark = files.sparkSession
    listed = files.select("file").withColumnRenamed("file", "_file")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
                  .withColumn("_name", F.substring_index("path", "/", -1)))
    return (found.join(listed, F.col("_name") == F.col("_file"), "left_semi").select("content")
                 .mapInPandas(read, "id string, url string, record_type string, refers_to string, payload_digest string, "
                                    "payload_bytes long, payload binary"))


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", **kw) -> DataFrame:
    """Write the archives of a table into a new shared folder and read every
    record back: the columns of `read_archives`, ids in their own type, and the
    digest and length recomputed from each response's payload."""
    folder = shared_folder(pages.sparkSession, "warc")
    files = write_archives(pages, folder, id_col=id_col, **kw)
    if not files.limit(1).count():
        got = pages.sparkSession.createDataFrame([], "id string, url string, record_type string, refers_to string, "
                                                     "payload_digest string, payload_bytes long, payload binary")
    else:
        got = read_archives(files, folder)
    kind = pages.schema[id_col].dataType
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return got.select(back("id").alias("id"), "url", "record_type", back("refers_to").alias("refers_to"), "payload_digest",
                      "payload_bytes", "payload")
