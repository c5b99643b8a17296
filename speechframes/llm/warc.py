"""WARC archives: an index first, then coalesced byte-range reads.

``write_archives`` writes archives of about 1 GB at most, one or more for each
task, into a folder that all executors share, each record a gzip member of its own, and with it an index:
for each record the archive, offset, length, URL and payload digest. ``read_records`` takes any selection of index
rows, sorts them by archive and offset, joins neighbouring ranges into few
large reads, and parses the records out of them.

A payload that occurs more than once is stored once: the record of the smallest
page id is a response, the others are revisits that refer to it. Which record
that is comes from a grouped minimum over digests and a join, so that a payload
shared by a third of all pages is split like any other large join key.

Tasks may run more than once. Each attempt writes a file of its own, and only
the rows of the attempt that Spark accepts reach the index, so what a lost
executor left behind is never read.

Defined cases: a null payload is empty; a null URL is written as an empty
target; of rows that repeat the smallest page id with an equal payload each is
a response; rows without page id are responses and nothing refers to them; line
breaks inside a URL are percent-encoded; an empty table gives an empty index and
no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import new_path, pieces, table, utf8

INDEX_SCHEMA = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
GAP, SPAN = 64 << 10, 8 << 20
FLUSH = 4 << 20
ROLL = 1 << 30  # an archive of this size is closed and another begun
GZIP_LEVEL = 4
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str, place: str) -> str:
    """The id of a page's record; a page without id is named by the place of its record."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{place if page_id is None else page_id} {url}')}>"


def escaped(url: str | None) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str, payload: bytes, refers_to: tuple[int, str] | None, place: str = "") -> tuple[bytes, str]:
    """One record and its payload digest. A revisit carries the length and digest of the payload it leaves out,
    and the id and URL of the page it refers to."""
    named = digest(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, place)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{named}"]
    lines += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*refers_to, '')}", f"WARC-Refers-To-Target-URI: {refers_to[1]}", f"X-Refers-To-Page-ID: {refers_to[0]}"]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head + (payload if refers_to is None else b"")
    lines += [f"WARC-Block-Digest: sha1:{digest(body)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", GZIP_LEVEL, mtime=0), named


def parse(data: memoryview) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record whose gzip member fills data."""
    raw = gzip.decompress(data)
    top, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("the range does not start at a record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4:
        raise ValueError("the range does not end at the record's end")
    return fields, body.partition(b"\r\n\r\n")[2]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, path = filesystem(folder)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, offset, n = None, 0, 0
        for part in (p for batch in batches for p in pieces(batch, "payload")):
            rows = []
            for page_id, url, payload, refers_to, target in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "target")), strict=True):
                if out is not None and offset >= ROLL:
                    out.close()
                    out, offset = None, 0
                if out is None:
                    name, n = f"{stem}-{n:05d}.warc.gz", n + 1
                    if isinstance(where, fs.LocalFileSystem):
                        where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}", compression=None, buffer_size=FLUSH)
                url = escaped(url)
                data, named = record(page_id, url, payload, None if refers_to is None else (refers_to, escaped(target)), f"{name} {offset}")
                out.write(data)
                rows.append((name, offset, len(data), page_id, url, named, "response" if refers_to is None else "revisit"))
                offset += len(data)
            if rows:
                names = ["archive", "offset", "length", "page_id", "url", "payload_digest", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True)], names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives below ``folder`` and return their index, itself written to ``folder``/index.

    Equal payloads of at least ``least_bytes`` are stored once.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(F.col(payload_col)).alias("payload"))
    keyed = rows.withColumn("_sha", F.sha1("payload"))
    firsts = keyed.where(F.length("payload") >= least_bytes).groupBy("_sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    other = F.col("page_id") != F.col("_first.page_id")
    told = keyed.join(firsts, "_sha", "left").select("page_id", "url", "payload", F.when(other, F.col("_first.page_id")).alias("refers_to"), F.when(other, F.col("_first.url")).alias("target"))
    index = told.mapInArrow(_writer(f"{folder}/archives"), INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _reader(folder: str):
    def ranges(rows):
        """Runs of index rows that one read covers."""
        run = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > SPAN):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        opened = (None, None)
        for batch in batches:
            for run in ranges(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True)):
                name, start, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
                if opened[0] != name:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (name, where.open_input_file(f"{path}/{name}"))
                block = memoryview(opened[1].read_at(end - start, start))
                out = []
                for _, offset, length in run:
                    fields, payload = parse(block[offset - start : offset - start + length])
                    page, target = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                    kind, named, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (digest(payload) != named or len(payload) != size):
                        raise ValueError(f"record {page}: the payload is not what was written")
                    out.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(target) if target else None, size, named, payload if kind == "response" else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if opened[1] is not None:
            opened[1].close()

    return read


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows point to. Payloads of revisits are null; the rows they refer to hold them."""
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        selected.select("archive", "offset", "length")
        .repartitionByRange(parts, "archive", "offset")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(_reader(f"{folder}/archives"), RECORD_SCHEMA)
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
