"""Web archives with a two-level capture index.

Pages become WARC records, one gzip member each, in files of the shared folder; equal payloads are stored once and
revisited. The index sorts the records' keys (host reversed, then path) into compressed blocks. Each index file ends with a
directory of its blocks, and the top of the index has the first key of each file. A lookup searches top and directory by
bisection, reads the block's range, searches the block, and reads the record's range of the archive.

Files are written by executors through pyarrow's file systems, under names of one task attempt each; only the names that
a committed attempt returned are ever read, so lost executors and repeated tasks leave unused files at worst.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import materialise, new_folder, sub_batches

#: Production parameters: payload bytes from which equal ones are revisited, records in an index block, bytes of an
#: archive file, gzip level. DATE stands for the time of capture, which the pages don't have.
LEAST, BLOCK_LINES, FILE_BYTES, LEVEL, DATE = 100, 1000, 1 << 30, 6, "1970-01-01T00:00:00Z"
#: Payloads of more than HOT pages are joined by broadcast, if there are at most MOST_HOT of them.
HOT, MOST_HOT = 10_000, 200_000
#: Rows without payloads are about a fortieth of the pages: they are returned in a NARROW-th of the shuffle's partitions, or two a core.
NARROW = 16
#: Schemes of Hadoop's file systems under the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def file_system(folder: str):
    """(pyarrow file system, path in it) of a folder given as a URI, or as a path of this machine.

    Folders from `new_folder` are URIs of the file system that Spark's own writes go to. A scheme that pyarrow doesn't
    know raises an error, on the driver before any work."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"archives can't be written to {folder}: no file system for {scheme}") from e


def partitions(df: DataFrame) -> int:
    """As many as the session shuffles to: a number given is kept, while a few bytes of keys, behind which lie whole pages,
    would otherwise be put together into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fewer(rows: DataFrame) -> DataFrame:
    """rows without payloads, dealt evenly to fewer partitions if the session has many more, so that a result is written as fewer
    files. Whatever made the rows still runs in as many tasks as before."""
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, partitions(rows) // NARROW)
    return rows.repartition(n) if 2 * n <= partitions(rows) else rows


def capture_key(url: str = "url", page_id: str = "page_id") -> Column:
    """`com,example,www)/path?query 00000000000000000007`: control characters and spaces of host, path and query as %20.

    A URL without :// counts as a path without a host, a null one as empty; a null id as `null`."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[^/?#]*?://([^/?#]*)", 1))
    rest = F.regexp_replace(text, r"^[^/?#]*?://[^/?#]*", "")
    key = F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20\x7f]", "%20")
    return F.concat(key, F.lit(" "), F.coalesce(F.lpad(F.col(page_id).cast("string"), 20, "0"), F.lit("null")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response or revisit record; the HTTP header of a revisit tells the length of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers of the record and of its HTTP part, body of the HTTP part)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, body = rest[: int(found["Content-Length"])].partition(b"\r\n\r\n")
    found |= {f"HTTP {k}": v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return found, body


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with _digest, _first (the response's id, of a revisit only) and _revisit.

    Of the pages with equal payloads of at least `least` bytes, the smallest id (nulls aside) is the response; rows that repeat
    its id are responses as well. Which pages revisit others is found on ids and digests alone; digests of very many pages
    meet by broadcast, so that a payload of a third of all pages isn't gathered. Payloads are shuffled once, by page."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digested = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_bytes"))
    long_ones = materialise(digested.where(F.col("_bytes") >= least).select("page_id", "_digest"), "digests")
    first = long_ones.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    first = materialise(first, "responses", small=True)
    hot, cold = first.where(F.col("_n") > HOT), first
    parts = []
    if 0 < hot.limit(MOST_HOT + 1).count() <= MOST_HOT:  # rows of 80 bytes
        parts, cold = [long_ones.join(F.broadcast(hot), "_digest")], first.where(F.col("_n") <= HOT)
    parts.append(long_ones.join(cold, "_digest"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    revisits = found.where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(F.col("page_id").alias("_page"), F.col("_digest").alias("_of"), "_first").distinct()
    out = digested.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("_of")), "left")
    return out.select("page_id", "url", "html", "_digest", "_first", F.col("_first").isNotNull().alias("_revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per page and returns (key, file, offset, length) of each. A null html is an empty payload.

    Each task writes the captures of its archives as a Parquet file beside them and returns that file's name. Spark's own
    writer would fork a few processes for each of these many small files, if the folder is of a local file system."""
    records = with_revisits(pages, least).withColumn("key", capture_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        system, root = file_system(folder)
        out, name, at, captures, captured = None, "", 0, None, f"captures-{uuid.uuid4().hex}.parquet"
        try:
            for batch in sub_batches(batches, "html", 4_000_000):
                found = []
                for row in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        system.create_dir(root, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = packer.compress(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["_digest"], row["_first"], row["_revisit"])) + packer.flush()
                    out.write(raw)
                    found.append((row["key"], name, at, len(raw)))
                    at += len(raw)
                rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])
                captures = captures or parquet.ParquetWriter(f"{root}/{captured}", rows.schema, filesystem=system)
                captures.write_batch(rows)
        finally:
            for x in (out, captures):
                if x:
                    x.close()
        if captures:
            yield pa.RecordBatch.from_arrays([pa.array([captured])], names=["name"])

    # an archive or more for each partition of the shuffle, which are put together by size
    file_system(folder)
    names, schema = [r.name for r in records.mapInArrow(run, "name string").collect()], "key string, file string, offset long, length long"
    if not names:
        return pages.sparkSession.createDataFrame([], schema)
    return pages.sparkSession.read.schema(schema).parquet(*(f"{folder}/{n}" for n in names))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[bytes, str, int, int]]:
    """Writes the index files and returns the top level: (first key, file, offset and length of its directory), a row for
    each file, of which a shuffle makes as many as it has partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        directory, lines, out, at, name = [], [], None, 0, f"index-{uuid.uuid4().hex}.cdx.gz"

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(lines).encode(), 6)
            out.write(raw)
            directory.append((lines[0].split("\t", 1)[0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    flush()
        if out:
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([at]), pa.array([len(raw)])], names=["key", "file", "offset", "length"])

    ordered = captures.repartitionByRange(partitions(captures), "key").sortWithinPartitions("key")
    top = ordered.mapInArrow(run, "key string, file string, offset long, length long").collect()
    return sorted((r.key.encode(), r.file, r.offset, r.length) for r in top)


class Index:
    """Lookups in an index by key; keeps one directory, one block and a few open files."""

    def __init__(self, folder: str, top: list[tuple[bytes, str, int, int]]):
        self.system, self.root = file_system(folder)
        self.top, self.first, self.files = top, [t[0] for t in top], {}
        self.directory, self.block = (None, [], []), (None, [], [])

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)

    def entries(self, at: int) -> tuple[list[bytes], list[list]]:
        """(first keys, entries) of the directory of the file at a place of the top level."""
        if self.directory[0] != at:
            _, name, offset, length = self.top[at]
            found = json.loads(zlib.decompress(self.read(name, offset, length)))
            self.directory = (at, [f[0].encode() for f in found], found)
        return self.directory[1:]

    def lines(self, at: int, block: int) -> tuple[list[bytes], list[list[bytes]]]:
        if self.block[0] != (at, block):
            _, offset, length = self.entries(at)[1][block]
            rows = [line.split(b"\t") for line in zlib.decompress(self.read(self.top[at][1], offset, length)).split(b"\n")]
            self.block = ((at, block), [r[0] for r in rows], rows)
        return self.block[1:]

    def find(self, key: bytes) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of all records with the key. Equal keys lie in one file, but may fill several blocks."""
        at = bisect_right(self.first, key) - 1
        if at < 0:
            return []
        firsts, found = self.entries(at)[0], []
        block = max(0, bisect_left(firsts, key) - 1)
        while block < len(firsts) and firsts[block] <= key:
            keys, rows = self.lines(at, block)
            lo, hi = bisect_left(keys, key), bisect_right(keys, key)
            found += [(f.decode(), int(o), int(n)) for _, f, o, n in rows[lo:hi]]
            block += 1
        return found

    def record(self, place: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.read(*place), 31))


def lookup(wanted: DataFrame, folder: str, top: list[tuple[bytes, str, int, int]], key: str = "key") -> DataFrame:
    """For each row its key, record_type, record_id, refers_to, payload_digest, payload_bytes (as the HTTP header
    says) and payload (null in a revisit); all null for a key that the index doesn't have. Rows with equal keys get the
    records of that key in turn."""
    sent = wanted.sparkSession.sparkContext.broadcast(top)  # a row for each index file
    names = ["key", "record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows, size, last, places, turn = Index(folder, sent.value), [], 0, None, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text != last:
                    last, places, turn = text, index.find(text.encode()), 0
                if not places:
                    rows.append((text, *[None] * 6))
                else:
                    head, body = index.record(places[turn % len(places)])
                    turn, size, kind = turn + 1, size + len(body), head["WARC-Type"]
                    rows.append((text, kind, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Payload-Digest"], int(head["HTTP Content-Length"]), body if kind == "response" else None))
                if size >= 4_000_000 or len(rows) >= 5000:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()

    ordered = wanted.select(F.col(key).alias("key")).repartitionByRange(partitions(wanted), "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names))


def page_of(record_id: str) -> Column:
    return F.regexp_extract(F.col(record_id), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page, read back from the archives through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    top = build_index(write_archives(pages, folder), folder)
    found = lookup(pages.select(capture_key().alias("key")), folder, top)
    found = found.select(
        page_of("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
    return fewer(found)


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first from p where octet_length(encode(html)) >= 100 group by html)
select p.page_id, cast(octet_length(encode(p.html)) as bigint) as payload_bytes, sha256(p.html) as payload_digest,
  case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
  case when f.first is null or f.first = p.page_id then null else f.first end as refers_to
from p left join f on p.html = f.html
"""
