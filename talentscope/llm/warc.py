"""WARC archives of pages: write, read back, assemble transactions.

Every page row becomes three records: a request, a response (or a revisit of an
earlier equal payload) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Archives are gzip files of the text sink with the
record trailer as line separator, in the shared folder. Reading parses records
by Content-Length; assembling groups them by the response they belong to and
emits one nested row per capture. A record may name several others, and one that
names a response itself (a metadata record its request): such chains are followed
inside an archive.

What cannot be read does not end the job: a record without a usable length or with
a broken header, a truncated one, a damaged gzip member and text between records
become rows with an ``error`` and the bytes in question as payload, and reading goes
on at the next line that begins a record.

Defined cases: a NULL payload is an empty one; equal payloads of at least
``MIN_REVISIT`` bytes are revisits of the smallest page_id (all rows with that
id are responses); a NULL page_id is always a response; a NULL url has no
target; control characters and spaces of a url are percent-encoded; captures
whose response, request or metadata is missing have NULL there; an empty table
gives no archive and no capture; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StringType, StructField, StructType)

from talentscope.llm.common import shared_path

MIN_REVISIT = 100
RECORDS_PER_FILE = 3000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = StructType([
    StructField("record_id", StringType()), StructField("type", StringType()),
    StructField("concurrent_to", ArrayType(StringType())), StructField("target_uri", StringType()),
    StructField("date", StringType()), StructField("content_type", StringType()),
    StructField("refers_to", StringType()), StructField("declared_digest", StringType()),
    StructField("head", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("payload", BinaryType()),
    StructField("captures", ArrayType(StringType())), StructField("error", StringType()),
])


def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, body, digest, n_bytes, first_id): first_id is the page that a
    revisit refers to, NULL for responses. The digest groups are counted first
    (pre-aggregated), so only groups of two and more meet the pages again; a hot
    group is split by the skew join, as nothing after the join needs it whole."""
    body = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", body.alias("body")).select(
        "page_id", "url", "body", F.sha2(F.col("body").cast("binary"), 256).alias("digest"),
        F.octet_length("body").alias("n_bytes"))
    firsts = (base.filter(F.col("n_bytes") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", "first_id"))
    later = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    return base.join(firsts, "digest", "left").select(
        "page_id", "url", "body", "digest", "n_bytes", later.alias("first_id"))


def _uri(url: Column) -> Column:
    """The url with control characters and spaces percent-encoded."""
    parts = F.regexp_extract_all(url, F.lit(r"[\x00-\x20\x7F]|[^\x00-\x20\x7F]+"), F.lit(0))
    coded = F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(p)), 2, "0")))
        .otherwise(p)), "")
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def _record(kind: str | Column, record_id: Column, fields: list[tuple[str, Column]],
            block: Column) -> Column:
    """One record without its trailer; a field with a NULL value is left out."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind),
             F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <"), record_id, F.lit(">")]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
              for name, value in fields]
    lines += [F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
              block]
    return F.concat(*lines)


def records(classified: DataFrame) -> DataFrame:
    """The records of every page, one per row in a column ``value``."""
    def urn():
        return F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))
    d = classified.select("*", _uri(F.col("url")).alias("uri"), urn().alias("id_response"),
                          urn().alias("id_request"), urn().alias("id_metadata"))
    target = ("WARC-Target-URI", F.col("uri"))
    joined = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("id_response"), F.lit(">")))
    host = F.regexp_extract("uri", r"://([^/?#]*)", 1)
    path = F.regexp_extract("uri", r"://[^/?#]*(/[^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path),
                       F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = F.coalesce(request, F.lit(f"GET / HTTP/1.1{END}"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    again = F.col("first_id").isNotNull()
    response = _record(
        F.when(again, "revisit").otherwise("response"), F.col("id_response"),
        [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(again, PROFILE)),
         ("WARC-Refers-To-Page", F.col("first_id").cast("string")),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(again, head).otherwise(F.concat(head, F.col("body"))))
    all_three = F.array(
        _record("request", F.col("id_request"),
                [target, joined, ("Content-Type", F.lit("application/http; msgtype=request"))],
                request),
        response,
        _record("metadata", F.col("id_metadata"),
                [target, joined, ("Content-Type", F.lit("application/warc-fields"))],
                F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"),
                                    F.lit("\r\n")), F.lit(""))))
    return d.select(F.explode(all_three).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> str:
    (records(classify(pages, min_revisit)).write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


_RECORD = re.compile(rb"^WARC/1\.[0-9]", re.M)
_HEADER_END = re.compile(rb"\r?\n\r?\n")


def _inflate(content: bytes) -> tuple[bytes, str | None]:
    """All members of a gzip file, up to a damaged one; other content as it is."""
    out, error = [], None
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(content) + z.flush())
        except zlib.error:
            return b"".join(out), "damaged gzip member"
        if not z.eof:
            return b"".join(out), "gzip member without its end"
        content = z.unused_data
    return b"".join([*out, content]), error


def _records(data: bytes) -> Iterator[tuple[dict[str, list[str]], int, int, str | None]]:
    """(header fields, start and end of the block, what is wrong) of each record; a
    field's values are in a list, its name in lower case."""
    pos = 0
    while pos < len(data):
        m = _RECORD.search(data, pos)
        stop = m.start() if m else len(data)
        if data[pos:stop].strip():
            yield {}, pos, stop, "text between records"
        if not m:
            return
        end = _HEADER_END.search(data, stop)
        if not end:
            yield {}, stop, len(data), "header without an end"
            return
        fields: dict[str, list[str]] = {}
        for line in data[stop:end.start()].decode("utf-8", "replace").splitlines()[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), []).append(value.strip())
        length = (fields.get("content-length") or [""])[0]
        pos = end.end()
        if not (length.isascii() and length.isdigit()):
            yield fields, pos, pos, "no content length"
            continue
        begin, pos = pos, pos + int(length)
        yield fields, begin, min(pos, len(data)), None if pos <= len(data) else "truncated"


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes, str | None]]:
    """(header fields, block, what is wrong) of each record of an archive."""
    data, error = _inflate(content)
    for fields, begin, end, wrong in _records(data):
        yield fields, data[begin:end], wrong
    if error:
        yield {}, b"", error


def _row(fields: dict[str, list[str]], block: bytes, error: str | None, with_payload: bool) -> dict:
    def first(name):
        return (fields.get(name) or [None])[0]

    def bare(name):
        return first(name).strip("<>") if name in fields else None
    kind = first("warc-type")
    head, payload, size, digest = block, None, None, None
    if error:
        head, payload, size = b"", block, len(block)
    elif kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            for line in head.decode("utf-8", "replace").split("\r\n"):
                name, _, value = line.partition(":")
                if name.lower() == "content-length" and value.strip().isdigit():
                    size = int(value)
            digest = (first("warc-payload-digest") or "").rpartition(":")[2] or None
            payload = None
    return {"record_id": bare("warc-record-id"), "type": kind,
            "concurrent_to": [x.strip("<>") for x in fields.get("warc-concurrent-to", [])],
            "target_uri": first("warc-target-uri"), "date": first("warc-date"),
            "content_type": first("content-type"),
            "refers_to": first("warc-refers-to-page") or bare("warc-refers-to"),
            "declared_digest": first("warc-payload-digest"),
            "head": head.decode("utf-8", "replace"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if with_payload or error else None, "error": error}


def _captures(record_id: str | None, links: dict[str, list[str]]) -> list[str]:
    """The record itself if it names no other, else the records that its chain ends at."""
    named = links.get(record_id)
    if not named:
        return [record_id] if record_id else []
    if links.keys().isdisjoint(named):
        return sorted(set(named))
    ends, seen, todo = set(), set(), [record_id]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            further = links.get(at) or []
            todo += further
            if not further:
                ends.add(at)
    return sorted(ends)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; payload bytes and digest are computed from what is read
    (a revisit has those of the payload it repeats). ``with_payload=False`` leaves
    the payload itself out."""
    schema = RECORD_SCHEMA

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data, error = _inflate(content.as_py())
                found = list(_records(data))
                links = {f["warc-record-id"][0].strip("<>"):
                         [x.strip("<>") for x in f["warc-concurrent-to"]]
                         for f, *_ in found if "warc-record-id" in f and "warc-concurrent-to" in f}
                rows, size = [], 0
                for fields, begin, end, wrong in [*found, *([({}, 0, 0, error)] if error else [])]:
                    row = _row(fields, data[begin:end], wrong, with_payload)
                    row["captures"] = [] if wrong else _captures(row["record_id"], links)
                    rows.append(row)
                    size += end - begin
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary(),
             "concurrent_to": pa.list_(pa.string()), "captures": pa.list_(pa.string())}
    names = RECORD_SCHEMA.names
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, and the nested request,
    response and metadata records joined through their concurrent-to ids. Records
    that could not be read are left out."""
    parts = [f for f in RECORD_SCHEMA.names if f not in ("concurrent_to", "captures", "error")]

    def part(*kinds):
        return F.first(F.when(F.col("type").isin(*kinds), F.struct(*parts)), ignorenulls=True)
    rows = found.filter("error is null").select(F.explode("captures").alias("capture_id"), *parts)
    return rows.groupBy("capture_id").agg(
        F.max("target_uri").alias("target_uri"), part("request").alias("request"),
        part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def page_captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back, and
    returns (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = write_archives(pages, shared_path(spark, "warc"), min_revisit)
    found = assemble(read_archives(spark, path, with_payload=False))
    page = F.nullif(F.regexp_extract("metadata.head", r"pageId: (-?[0-9]+)", 1), F.lit(""))
    return found.filter("response is not null").select(
        page.cast("bigint").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").cast("bigint").alias("refers_to"))
