"""WARC archives written and read by Spark, with a two-level capture index.

Archives: one record per page; the text writer puts the end-of-record mark between records, so each file is a plain
concatenation of WARC records, sized for one task. Of equal payloads of at least ``LEAST_BYTES`` the page with the
smallest id holds the payload (response); others refer to it (revisit).

Index: captures are sorted by reversed-host URL key over all archives and packed into compressed blocks; a sparse
directory keeps the first and last key of every block. A lookup finds the index parts whose range holds the key (one
range per part, broadcast), then binary-searches the directory of that part, then the block, and only then reads byte
ranges of archives.

Nulls and edges: a null html is empty, a null url has an empty key; line breaks in urls are percent-encoded; a null page
id is written as none and comes back as null; equal rows with the smallest id are all responses, and payloads whose ids
are all null too; empty tables give archives without records and an index without blocks.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentlake.llm.text import written
from latentlake.plans.runtime import broadcast_if_small, scratch_path

LEAST_BYTES = 100
FILE_BYTES = 16 << 20
BLOCK_KEYS = 1_000
PART_KEYS = 500_000
SLICE_KEYS = 200_000
END = "\r\n\r\n"
ENTRY = "key string, page_id long, path string, offset long, length long"


def surt(url: str | None) -> str:
    """Key that sorts captures of a site together: host labels reversed, then path and query."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    host, _, port = m[1].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/")


# --- writing -----------------------------------------------------------------------------------------------------------

def _record(date: str) -> Column:
    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))), line("WARC-Target-URI", url), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                                 line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages (page_id, url, html) in ``folder``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    mean = rows.agg(F.avg("payload_bytes")).first()[0] or 0
    first = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("first_page")) \
        .where("_n > 1").select("digest", "first_page")
    rows = rows.join(broadcast_if_small(first, 160), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")))
    rows.select(_record(date)).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(file_bytes // (mean + 500)))).text(folder)


# --- reading -----------------------------------------------------------------------------------------------------------

def _number(urn: str | None) -> int | None:
    body = urn[len("<urn:page:"):-1] if urn else "none"
    return None if body == "none" else int(body)


def parse(record: bytes) -> dict:
    """A record's headers, page ids and payload; ValueError if its payload doesn't have the digest it says."""
    head, _, rest = bytes(record).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")
    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
        raise ValueError("payload and digest differ")
    return {"page_id": _number(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": kind, "digest": said,
            "refers_to": _number(headers.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _walk(read, size: int, path: str) -> Iterator[tuple]:
    """(key, page_id, path, offset, length) of the records of a file; read(offset, n) gives bytes, payloads are stepped over."""
    at = 0
    while at < size:
        n = 2048  # headers are short; longer ones are read again with more
        while (cut := (head := read(at, n)).find(b"\r\n\r\n")) < 0 and at + n < size:
            n *= 4
        headers = dict(x.split(": ", 1) for x in head[:cut].decode().split("\r\n")[1:])
        length = cut + 4 + int(headers["Content-Length"])
        yield surt(headers["WARC-Target-URI"]), _number(headers["WARC-Record-ID"]), path, at, length
        at += length + len(END)


def _windowed(file, width: int = 1 << 20):
    """read(offset, n) over a file, through a window that moves forward."""
    held, start = b"", 0

    def read(at: int, n: int) -> bytes:
        nonlocal held, start
        if at < start or at + n > start + len(held):
            file.seek(at)
            held, start = file.read(max(n, width)), at
        return held[at - start:at - start + n]

    return read


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """(key, page_id, path, offset, length) of all records: a task walks a file from header to header.

    In a store that pyarrow can't open, Spark reads the files.
    """
    files = spark.read.format("binaryFile").load(folder)
    one = files.select("path").first()
    ranges = one is None or _by_ranges(one[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, content in zip(*b.columns):
                path, size = path.as_py(), size.as_py()
                if ranges:
                    with _opened(path) as file:
                        yield _table(list(_walk(_windowed(file), size, path)))
                else:
                    data = memoryview(content.as_buffer())
                    yield _table(list(_walk(lambda at, n, data=data: bytes(data[at:at + n]), size, path)))

    return files.select("path", "length", F.lit(b"").alias("content") if ranges else F.col("content")).mapInArrow(run, ENTRY)


def _pack(entries: list[tuple]) -> bytes:
    rows = [f"{key}\t{'' if page is None else page}\t{path}\t{offset}\t{length}" for key, page, path, offset, length in entries]
    return zlib.compress("\n".join(r.replace("\n", " ") for r in rows).encode())


def _unpack(block: bytes) -> list[tuple]:
    out = []
    for row in zlib.decompress(block).decode().split("\n"):
        key, page, path, offset, length = row.rsplit("\t", 4)
        out.append((key, int(page) if page else None, path, int(offset), int(length)))
    return out


def build_index(entries: DataFrame, block_keys: int = BLOCK_KEYS, part_keys: int = PART_KEYS) -> DataFrame:
    """(part, block, first_key, last_key, n, data): sorted blocks, parts are ranges of keys."""
    n = max(1, -(-entries.count() // part_keys))
    dealt = entries.repartitionByRange(n, "key", "page_id", "path", "offset").withColumn("part", F.spark_partition_id()) \
        .sortWithinPartitions("key", "page_id", "path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, number = [], 0, 0

        def block():
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "first_key": held[0][0], "last_key": held[-1][0], "n": len(held), "data": _pack(held)}], schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int32()), ("data", pa.binary())])
        for b in batches:
            for key, page, path, offset, length, part in zip(*(b.column(i).to_pylist() for i in range(6))):
                held.append((key, page, path, offset, length))
                if len(held) == block_keys:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    return written(dealt.mapInArrow(run, "part int, block int, first_key string, last_key string, n int, data binary"), "index")


def every_entry(index: DataFrame) -> DataFrame:
    """All captures of an index in the order of their keys within a part."""
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield _table(_unpack(data))

    return index.select("data").mapInArrow(run, ENTRY)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                      ["key", "page_id", "path", "offset", "length"])


def lookup(index: DataFrame, urls: DataFrame, url: str = "url", slice_keys: int = SLICE_KEYS) -> DataFrame:
    """Captures of the urls' keys; keys that the index doesn't have give none.

    Keys of a part are dealt into slices of about ``slice_keys``, so that no call holds more of them, however many fall
    between two captures.
    """
    # one range per part of the index reaches the driver: a part has PART_KEYS captures
    ranges = sorted((r["lo"], r["hi"], r["part"]) for r in index.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]

    def parts(batches):
        for b in batches:
            out = [(k, ranges[i][2]) for k in {surt(u) for u in b.column(0).to_pylist()}
                   for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], ["key", "part"])

    wanted = written(urls.select(F.col(url)).mapInArrow(parts, "key string, part int").distinct(), "wanted")
    slices = F.broadcast(wanted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / slice_keys).cast("int").alias("slices")))  # one row per part
    asked = wanted.join(slices, "part").select("key", "part", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("slice"))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    directory = index.select("part", "block", "first_key", "last_key").join(slices, "part").select("part", "block", "first_key", "last_key", every)

    def find(queries: pa.Table, directory: pa.Table) -> pa.Table:
        rows = sorted(zip(directory.column("first_key").to_pylist(), directory.column("last_key").to_pylist(), directory.column("block").to_pylist()), key=lambda r: r[2])
        first, last = [r[0] for r in rows], [r[1] for r in rows]
        out = [(k, p, s, rows[i][2]) for k, p, s in zip(*(queries.column(c).to_pylist() for c in ("key", "part", "slice")))
               for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate((("key", pa.string()), ("part", pa.int32()), ("slice", pa.int32()), ("block", pa.int32())))})

    blocks = asked.groupBy("part", "slice").cogroup(directory.groupBy("part", "slice")).applyInArrow(find, "key string, part int, slice int, block int")
    blocks = written(blocks, "blocks")

    def read(queries: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        keys = sorted(queries.column("key").to_pylist())
        for data in held.column("data").to_pylist() if keys else []:
            entries = _unpack(data)
            names = [e[0] for e in entries]
            for k in keys:
                out += entries[bisect.bisect_left(names, k):bisect.bisect_right(names, k)]
        return pa.Table.from_batches([_table(out)])

    needed = blocks.select(*[F.col(c).alias(f"_{c}") for c in ("part", "block", "slice")]).distinct()
    held = index.join(needed, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))).select("_part", "_block", "_slice", "data")
    return blocks.groupBy("part", "block", "slice").cogroup(held.groupBy("_part", "_block", "_slice")).applyInArrow(read, ENTRY)


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _by_ranges(path: str) -> bool:
    try:
        _opened(path).close()
    except Exception:  # noqa: BLE001  whatever a store says that only Spark can open
        return False
    return True


RECORDS = "page_id long, url string, record_type string, digest string, refers_to long, payload binary"


def read_records(entries: DataFrame) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload) of captures, by byte ranges of the archives.

    Ranges of a file are read in order. In a store that pyarrow can't open, Spark reads the files and cuts them.
    """
    spark, one = entries.sparkSession, entries.select("path").first()
    if one is None or _by_ranges(one[0]):
        dealt = entries.select("path", "offset", "length").repartition("path", F.floor(F.col("offset") / FILE_BYTES)).sortWithinPartitions("path", "offset")

        def ranges(batches):
            name, file = None, None
            for b in batches:
                for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if path != name:
                        if file:
                            file.close()
                        file, name = _opened(path), path
                    file.seek(offset)
                    yield file.read(length)
            if file:
                file.close()

        def run(batches):
            yield from _parsed(ranges(batches))

        return dealt.mapInArrow(run, RECORDS)
    folder = one[0].rsplit("/", 1)[0]
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    cut = entries.join(files, "path").select(F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int")).alias("r"))

    def parsed(batches):
        yield from _parsed(r for b in batches for r in b.column(0).to_pylist())

    return cut.mapInArrow(parsed, RECORDS)


def _parsed(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    held, size = [], 0
    for r in records:
        held.append(parse(r))
        size += len(r)
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits with the payload that they refer to."""
    slim = written(records.select("page_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    held = slim.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("there"))
    out = slim.join(held, ["refers_to", "digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "there").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame) -> tuple[str, DataFrame]:
    """Archives of the pages in a folder of their own, and their index."""
    folder = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, folder)
    return folder, build_index(written(captures(pages.sparkSession, folder), "captures"))
