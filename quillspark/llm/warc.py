"""WARC archives: records written with an index of their places, and read back by coalesced byte ranges of what the index selects."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir, stage_table

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: An archive is closed at about so many bytes.
ARCHIVE = 256 << 20
#: Records at most GAP bytes apart are read at once, in ranges that begin in the same RANGE bytes of an archive.
GAP, RANGE = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _uri(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of its file system, as tasks open it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def _line(value: str) -> bytes:
    """A header value in which white space, controls and per cent signs before them can't break the line."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], value.encode("utf-8", "surrogatepass"))


def record_bytes(kind: str, record_id: str, url: str | None, digest: str, refers_to: str | None, payload: bytes, date: str = DATE) -> bytes:
    """One record, without compression: a response with the payload in an HTTP message, or a revisit with its head alone."""
    head = _HTTP % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <%s>" % record_id.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _line(url))
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if kind == "revisit":
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <%s>" % (refers_to or "").encode()]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header lines of a record and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    named = dict(x.split(": ", 1) for x in (y.decode("utf-8", "surrogatepass") for y in lines))
    size = int(named["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't agree with its header")
    return named, rest[:size]


def plan_records(pages: DataFrame, name: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, record_id, refers_id): refers_id is the record that a revisit refers to, null for a response.

    Of equal payloads of least_bytes or more the row with the smallest page_id is the response, null ids last, then the
    smallest url; of rows that repeat all three one is. Digests move alone; payloads meet the digests that repeat.
    """
    p = pages.select(F.col(name).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    narrow = stage_table(p.select("page_id", "url", "digest", (F.octet_length("payload") >= least_bytes).alias("is_large")), "digests")
    rows = narrow.groupBy("page_id", "url", "digest", "is_large").agg(F.count(F.lit(1)).alias("copies"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    repeats = stage_table(rows.where("copies > 1").select(F.col("page_id").alias("r_id"), F.col("url").alias("r_url"), F.col("digest").alias("r_digest"), "copies"), "repeats")
    p = p.withColumn("no", F.lit(1).cast("long"))
    if not repeats.isEmpty():  # rows that repeat are one, then as many again, each with a number
        on = same("page_id", "r_id") & same("url", "r_url") & (F.col("digest") == F.col("r_digest"))
        once = p.join(repeats, on).dropDuplicates(["page_id", "url", "digest"])
        once = once.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*p.columns)
        p = p.join(repeats, on, "left_anti").unionByName(once)
    record_id = lambda i, u, d, no: F.concat(F.lit("urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), no.cast("string"), F.lit(":"), F.substring(F.sha2(F.coalesce(u, F.lit("")).cast("binary"), 256), 1, 16), F.when(u.isNull(), "-").otherwise(":"), F.substring(d, 1, 16))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")).alias("x")
    shared = rows.where("is_large").groupBy("digest").agg(first, F.sum("copies").alias("n")).where("n > 1")
    shared = stage_table(shared.select("digest", record_id(F.col("x.page_id"), F.col("x.url"), F.col("digest"), F.lit(1)).alias("first_id")), "shared")
    p = p.withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("no")))
    p = p.join(shared, "digest", "left")
    return p.select("page_id", "url", "payload", "digest", "record_id", F.when(F.col("first_id") != F.col("record_id"), F.col("first_id")).alias("refers_id"))


def write_archives(pages: DataFrame, folder: str | None = None, name: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, level: int = 4) -> DataFrame:
    """The index of new archives below folder: path, offset, length, page_id, url, digest, payload_bytes, record_type, record_id, refers_id.

    Each task writes the records of its rows, a gzip member each, to archives of its own, whose names a retry does not
    take again; the index names only those of tasks that ended well, and is written before anything is read. folder must
    be one that all executors reach; by default it is made under spark.checkpoint.dir. Null payloads are empty, null urls
    have no target line; nulls, repeated rows and equal payloads see plan_records. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    to = _uri(spark, folder or f"{shared_dir(spark)}/warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(to)
        out, path, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for r in range(b.num_rows):
                    url, payload, digest, record_id, refers_id = (b.column(c)[r].as_py() for c in ("url", "payload", "digest", "record_id", "refers_id"))
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        files.create_dir(base, recursive=True)
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out, path = files.open_output_stream(f"{base}/{file}", compression=None), f"{to}/{file}"
                    kind = "revisit" if refers_id else "response"
                    z = zlib.compressobj(level, wbits=31)
                    member = z.compress(record_bytes(kind, record_id, url, digest, refers_id, payload)) + z.flush()
                    out.write(member)
                    rows.append((path, at, len(member), len(payload), kind))
                    at += len(member)
                made = [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*made, *(b.column(c) for c in ("page_id", "url", "digest", "record_id", "refers_id"))], names=["path", "offset", "length", "payload_bytes", "record_type", "page_id", "url", "digest", "record_id", "refers_id"])
        finally:
            if out is not None:
                out.close()

    rows = plan_records(pages, name, url, payload, least_bytes)
    return stage_table(rows.mapInArrow(run, "path string, offset bigint, length bigint, payload_bytes bigint, record_type string, page_id bigint, url string, digest string, record_id string, refers_id string"), "index")


def byte_ranges(index: DataFrame, gap: int = GAP, span: int = RANGE) -> DataFrame:
    """(path, range_no, start, end, records): the records of index in few reads, each an array of (offset, length) in order.

    An archive is of bounded size, and so is the window over its records.
    """
    order = Window.partitionBy("path").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    begins = end.isNull() | (F.col("offset") - end > gap) | (F.floor(F.col("offset") / span) != F.floor(F.lag("offset").over(order) / span))
    r = index.select("path", "offset", "length").distinct().withColumn("begins", begins.cast("int")).withColumn("range_no", F.sum("begins").over(order))
    return r.groupBy("path", "range_no").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(index: DataFrame, gap: int = GAP, span: int = RANGE) -> DataFrame:
    """(path, offset, record_type, record_id, refers_id, page_id, url, digest, payload) of the records that the rows of index select.

    Places are sorted and merged into ranges first (byte_ranges), and a task opens an archive for a range and reads it at
    once. A response's payload is held against the digest of its header; a revisit has a null payload. url is that of the
    header, where white space and controls are per cent codes. A place named twice is read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for r in range(b.num_rows):
                path, start, end, records = (b.column(c)[r].as_py() for c in ("path", "start", "end", "records"))
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_file(at) as f:
                    raw = memoryview(f.read_at(end - start, start))
                rows, size = [], 0
                for x in records:
                    o = x["offset"] - start
                    named, block = parse_record(zlib.decompress(raw[o : o + x["length"]], wbits=31))
                    payload, digest = None, named["WARC-Payload-Digest"].removeprefix("sha256:")
                    if named["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {x['offset']}: the payload doesn't have the digest of its header")
                    record_id = named["WARC-Record-ID"][1:-1]
                    number = record_id.split(":")[2]
                    rows.append((path, x["offset"], named["WARC-Type"], record_id, named["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in named else None, None if number == "null" else int(number), named.get("WARC-Target-URI"), digest, payload))
                    size += len(block)
                    if size > span:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return byte_ranges(index, gap, span).select("path", "start", "end", "records").mapInArrow(run, _READ)


_READ = "path string, offset bigint, record_type string, record_id string, refers_id string, page_id bigint, url string, digest string, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def resolve_revisits(records: DataFrame, *columns: str) -> DataFrame:
    """records with those columns of a revisit taken from the response it refers to, and refers_to, that one's page_id."""
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), *[F.col(c).alias(f"known_{c}") for c in columns])
    again = records.where("record_type = 'revisit'").join(known, "refers_id", "left")
    again = again.select(*[F.col(f"known_{c}").alias(c) if c in columns else F.col(c) for c in records.columns], "refers_to")
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
