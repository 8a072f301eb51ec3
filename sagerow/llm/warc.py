"""WARC archives, written and read index first.

Writing tasks append gzip members (one a record) to archive files in the
shared folder and return one index row per record: file, offset, length,
URL and payload digest. Reading selects index rows, sorts them, merges
neighbouring byte ranges into single reads, and parses only those records.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, sized, slices, staged

#: Payloads from this many bytes on are stored once, equal ones as revisits.
REVISIT_BYTES = 1000
#: A task starts a new archive file beyond this size.
FILE_BYTES = 64 << 20
#: Byte ranges of one file this near are read at once, within windows of RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture date
INDEX = "file string, offset long, length long, url string, digest string"


def _open(folder: str):
    """The file system of a folder's URI or absolute path, and the folder's path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def escaped(value: str) -> str:
    """A header value on one line: CR and LF as %0D and %0A (a URL stands for the same address), all else as it is."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def id_field(page: str) -> str:
    """An id for our own header fields, whatever it holds: a JSON string (ASCII, one line)."""
    return json.dumps(page)


def record(
    page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, name: str, refers_to_name: str | None
) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone and names the response it repeats.

    ``name`` and ``refers_to_name`` are the records' UUIDs.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {id_field(page)}")
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to_name}>", f"X-Refers-To-Page: {id_field(refers_to or '')}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (our own ids read back) and its payload (what follows the block's HTTP header)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    for own in ("X-Page-Id", "X-Refers-To-Page"):
        if own in fields:
            fields[own] = json.loads(fields[own])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_roles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page, url, payload, digest, refers_to, refers_to_url, revisit, referred) of every row.

    Of equal payloads of at least ``REVISIT_BYTES`` the largest id is the
    response; rows repeated with that very id are responses too, and the one
    with the largest URL is referred to. Null ids rank last. Only payloads
    that occur twice are looked up.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    again = large.groupBy("key").agg(F.max(F.struct("page", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    again = again.select("key", F.col("top.page").alias("first"), F.col("top.url").alias("first_url"))
    twice = sized(staged(again, "warc-repeats"))
    joined = rows.join(twice, "key", "left")
    revisit: Column = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    top = F.col("first").isNotNull() & F.col("page").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    return joined.select(
        "page", "url", "payload", F.sha1("payload").alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"), revisit.alias("revisit"), top.alias("referred"),
    )


def referred_name(page: str, url: str | None, digest: str) -> str:
    """The UUID of a response that revisits name, from what both know of it."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page, url, digest])))


def write_archives(roles: DataFrame, folder: str) -> DataFrame:
    """Write all rows to gzipped archives under ``folder`` (shared by all executors) and return the staged index.

    A file belongs to one attempt of one task; the index names only files
    of attempts that Spark committed, so what a lost or repeated attempt
    left behind is never read. Every record has a UUID of its own; only rows
    equal in id, URL and payload that others refer to share one.
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    fields = ("page", "url", "payload", "digest", "refers_to", "refers_to_url", "revisit", "referred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches):
                rows: list[tuple] = []
                for page, url, payload, digest, to, to_url, revisit, referred in zip(*(batch.column(c).to_pylist() for c in fields)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    own = referred_name(page, url, digest) if referred else str(uuid.uuid4())
                    of = referred_name(to, to_url, digest) if revisit else None
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, to, revisit, own, of)) + packer.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest))
                    at += len(member)
                cols = list(zip(*rows)) or [[]] * 5
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], ["file", "offset", "length", "url", "digest"]
                )
        finally:
            if out is not None:
                out.close()

    text = roles.select(
        *[F.col(c).cast("string").alias(c) if c in ("page", "refers_to") else F.col(c) for c in fields]
    )
    return staged(text.mapInArrow(run, INDEX), "warc-index")


def byte_ranges(selected: DataFrame) -> DataFrame:
    """(file, start, stop, offsets, lengths): sorted neighbours of the selected index rows merged into single reads."""
    order = Window.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    gap = F.col("offset") - F.lag(end).over(order)
    far = F.floor(F.col("offset") / RANGE_BYTES) != F.floor(F.lag("offset").over(order) / RANGE_BYTES)
    marked = selected.select("file", "offset", "length", F.coalesce((gap > GAP_BYTES) | far, F.lit(True)).alias("new"))
    runs = marked.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("offset", "length")))
    merged = runs.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), parts.alias("parts"))
    return merged.select("file", "start", "stop", F.col("parts.offset").alias("offsets"), F.col("parts.length").alias("lengths"))


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """(page, record_type, refers_to, digest, payload) of the index rows selected, by merged byte-range reads.

    ``digest`` is the record's header field; ``payload`` what its block holds (a revisit's is empty).
    """
    fields = ["page", "record_type", "refers_to", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}") as f:
                    raw = f.read_at(r["stop"] - r["start"], r["start"])
                cols: list[list] = [[], [], [], []]
                payloads = []
                for offset, length in zip(r["offsets"], r["lengths"]):
                    a = offset - r["start"]
                    head, payload = parse(zlib.decompress(raw[a : a + length], 31))
                    values = (head.get("X-Page-Id"), head["WARC-Type"], head.get("X-Refers-To-Page"), head["WARC-Payload-Digest"][5:])
                    for c, v in zip(cols, values):
                        c.append(v)
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.string()) for c in cols], pa.array(payloads, pa.binary())], [*fields, "payload"]
                )

    return byte_ranges(selected).mapInArrow(run, ", ".join(f"{c} string" for c in fields) + ", payload binary")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as read back from the archives written.

    Null html is an empty payload, a null id or URL a record without that
    field. A revisit's payload figures are those of the response it refers
    to. Rows repeated with the same id are a record each; ids may be strings
    of any characters; a payload of any length is one record; an empty table
    gives an empty one. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    index = write_archives(page_roles(pages, id_col, html_col), folder)
    read = read_records(index, folder)
    kind = pages.schema[id_col].dataType
    rows = staged(
        read.select(
            F.col("page").cast(kind).alias("page"),
            "record_type",
            F.col("refers_to").cast(kind).alias("refers_to"),
            "digest",
            F.octet_length("payload").cast("long").alias("bytes"),
            F.sha1("payload").alias("sha"),
        ),
        "warc-read",
    )
    responses = rows.where("record_type = 'response'")
    sources = responses.where("page is not null").groupBy(F.col("page").alias("p"), F.col("sha").alias("s")).agg(F.min("bytes").alias("b"))
    revisits = rows.where("record_type = 'revisit'").select("page", "record_type", "refers_to", "digest")
    resolved = revisits.join(sources, (F.col("refers_to") == F.col("p")) & (F.col("digest") == F.col("s")), "left")
    return responses.select(
        F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(
        resolved.select(
            F.col("page").alias("page_id"), F.col("b").alias("payload_bytes"), F.col("s").alias("payload_digest"), "record_type", "refers_to"
        )
    )


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), k AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest,
         CASE WHEN octet_length(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM k
"""
