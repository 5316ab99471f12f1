"""WARC archives: writing, reading, and assembly of transactions."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.llm.store import materialize, renamed
from varienne.session import hint_if_small

#: Captures per file; a file is one row while it is read.
CAPTURES_PER_FILE = 1500
#: Fixed values of the format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSES = ("response", "revisit", "resource", "conversion")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(kind: str, key: Column) -> Column:
    """A record id that depends only on the kind and the key."""
    h = F.md5(F.concat(F.lit(kind + ":"), key).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(kind: Column | str, block: Column, content_type: str, headers: list[tuple[str, Column]], date: str) -> Column:
    """Header and block of a record, without the blank lines that end it; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.lit(f"WARC-Date: {date}")]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Write every page as a request, a response or revisit, and a metadata record.

    Of pages with equal payloads the one with the largest id becomes the response (the last row, if ids
    tie), the others revisits that refer to it; null ids come before all others.  Null payloads are empty.
    Line breaks in URLs are percent-encoded; a page without URL has no target header.  The files are
    written by Spark's text writer with blank lines as separator, so a lost task leaves no broken file.
    An empty table gives archives without records; rows that repeat an id are captures of their own.  Payloads of any length are written whole; a
    file is bounded by its number of captures, not by bytes, and a file that is read must fit a row.
    """
    row = F.monotonically_increasing_id()
    source = renamed(pages, id_col, url_col, payload_col, to=("id", "url", "payload")).select(
        F.col("id").cast("bigint").alias("id"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("payload", F.lit("")).alias("payload"), row.alias("row"))
    source = source.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    first = source.groupBy("digest").agg(F.max(F.struct("id", "row", "url")).alias("first"))
    page = source.join(first, "digest")
    own = F.col("first.row") == F.col("row")
    key, original = F.col("row").cast("string"), F.col("first.row").cast("string")
    response = record_uri("response", key)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    request = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    main = [("WARC-Record-ID", response), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(~own, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(~own, record_uri("response", original))),
            ("WARC-Refers-To-Target-URI", F.when(~own, F.col("first.url")))]
    beside = lambda kind: [("WARC-Record-ID", record_uri(kind, key)), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", response)]
    value = F.concat_ws(
        CRLF * 2,
        record_text("request", request, "application/http; msgtype=request", beside("request"), date),
        record_text(F.when(own, "response").otherwise("revisit"), F.when(own, F.concat(http, "payload")).otherwise(http), "application/http; msgtype=response", main, date),
        record_text("metadata", F.concat(F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string")), F.lit("id:")), F.lit(CRLF)), "application/warc-fields", beside("metadata"), date))
    page.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", captures_per_file).text(path)


RECORDS = ("file string, at bigint, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, digest string, "
           "payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary")


def _inflated(content: bytes) -> bytes:
    """All gzip members of a file, or the file itself."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _fields(lines: bytes) -> list[tuple[str, str]]:
    pairs = [x.partition(":") for x in lines.decode("utf-8", "replace").replace("\r\n ", " ").split("\r\n")]
    return [(k.strip().lower(), v.strip()) for k, s, v in pairs if s]


def records_of(content: bytes):
    """(offset, header fields, block) of every record; a cut-off last record raises an error."""
    at = 0
    while True:
        while content[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(content):
            return
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at:at + 5] != b"WARC/":
            raise ValueError(f"no record header at byte {at}")
        head = _fields(content[at:end])
        size = int(dict(head)["content-length"])
        if end + 4 + size > len(content):
            raise ValueError(f"record at byte {at} is cut off")
        yield at, head, content[end + 4:end + 4 + size]
        at = end + 4 + size


def parse(with_payload: bool):
    """Function for ``mapInArrow``: (path, content) to records."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, head, block in records_of(_inflated(content.as_py())):
                    h = dict(head)
                    kind, payload = h.get("warc-type"), block
                    if kind in RESPONSES and h.get("content-type", "").startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    bare = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    body = kind in RESPONSES and kind != "revisit"
                    rows.append((
                        path.as_py(), at, kind, h.get("warc-record-id"), [v for k, v in head if k == "warc-concurrent-to"], h.get("warc-refers-to"), h.get("warc-target-uri"), bare,
                        len(payload) if body else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if body else None,
                        _fields(block) if h.get("content-type") == "application/warc-fields" else None, payload if with_payload and body else None))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
                         pa.map_(pa.string(), pa.string()), pa.binary()]
                names = ["file", "at", "type", "record_id", "concurrent_to", "refers_to", "target_uri", "digest", "payload_bytes", "payload_digest", "fields", "payload"]
                for lo in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo:lo + 500]], k) for i, k in enumerate(kinds)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below a path, plain or gzip, with one or many members.

    Lengths and digests are taken from the payload bytes themselves; payloads only come along on request.
    A file is one row while it is parsed, so archives should be written in files of bounded size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse(with_payload), RECORDS)


def without_repeats(records: DataFrame) -> DataFrame:
    """The records, of those with one id only the first by file and place; records without an id all stay.

    Only ids and places are shuffled to find what repeats, and usually nothing does.
    """
    first = records.where("record_id is not null").groupBy("record_id").agg(F.count("*").alias("n"), F.min(F.struct("file", "at")).alias("first")).where("n > 1")
    first = materialize(first.select(F.col("record_id").alias("again"), "first"), "repeats")
    if first.isEmpty():
        return records
    marked = records.join(hint_if_small(first), F.col("record_id") == F.col("again"), "left")
    return marked.where(F.col("again").isNull() | ((F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.at")))).drop("again", "first")


def transactions(records: DataFrame) -> DataFrame:
    """Join the records of every capture through their concurrent-to identifiers.

    Returns one row per response or revisit: its columns, ``requests`` and ``metadata`` (arrays of
    structs, by record id).  The identifiers count in both directions, and a record that names only a
    sibling (metadata that names the request) follows it to the capture.  Records that lead to no
    capture come back as a row of their own with null type, so none is lost.  Records without an id are
    captures without parts or such rows.  Of records with one id, as in an archive that is read twice, the
    first by file and place counts.  Hot captures are grouped after a join on ids alone.
    """
    records = without_repeats(records)
    own = F.col("type").isin(*RESPONSES)
    captures = records.where(own)
    parts = records.where(~own | F.col("type").isNull()).where("type is null or type <> 'warcinfo'")
    ids = records.where("record_id is not null").select("record_id", own.alias("capture"))
    named = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a is not null")
    links = named.union(named.select("b", "a")).distinct()
    links = links.join(ids.select(F.col("record_id").alias("b"), F.col("capture").alias("to_capture")), "b").join(ids.select(F.col("record_id").alias("a"), F.col("capture").alias("from_capture")), "a").where("not from_capture")
    direct = links.where("to_capture").select(F.col("a").alias("part"), F.col("b").alias("owner"))
    further = links.where("not to_capture").join(direct.select(F.col("part").alias("b"), "owner"), "b").select(F.col("a").alias("part"), "owner")
    owners = direct.union(further.join(direct.select("part").distinct(), "part", "left_anti")).distinct()
    placed = parts.join(owners, parts["record_id"] == owners["part"], "left")
    grouped = placed.where("owner is not null").groupBy("owner").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", _comparable()))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", _comparable()))).alias("metadata"))
    whole = captures.join(grouped, captures["record_id"] == grouped["owner"], "left").drop("owner", "concurrent_to", "fields")
    orphans = placed.where("owner is null").select(
        "file", "at", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("record_id"), "refers_to", "target_uri", "digest", "payload_bytes", "payload_digest", "payload",
        F.array(F.when(F.col("type") == "request", _comparable())).alias("requests"), F.array(F.when(F.coalesce(F.col("type") != "request", F.lit(True)), _comparable())).alias("metadata"))
    orphans = orphans.withColumn("requests", F.array_compact("requests")).withColumn("metadata", F.array_compact("metadata"))
    return whole.unionByName(orphans)


def _comparable() -> Column:
    """A part as a struct that can be sorted; fields as entries, because maps cannot."""
    return F.struct("record_id", "type", "target_uri", F.map_entries("fields").alias("fields"))


def field(parts: Column, name: str) -> Column:
    """First value of a field in the metadata parts of a capture."""
    entries = F.flatten(F.transform(parts, lambda p: F.coalesce(p["fields"], F.array().cast("array<struct<key:string,value:string>>"))))
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def resolved(captures: DataFrame) -> DataFrame:
    """Captures with the length and digest of the full payload; revisits take them from what they refer to.

    A revisit whose response is not among the captures keeps its declared digest and a null length.
    ``refers`` is the metadata of the response.
    """
    known = captures.where("type <> 'revisit'").select(F.col("record_id").alias("target"), F.col("payload_bytes").alias("there_bytes"), F.col("payload_digest").alias("there_digest"), F.col("metadata").alias("refers"))
    out = captures.join(known, captures["refers_to"] == known["target"], "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "there_bytes")).withColumn("payload_digest", F.coalesce("payload_digest", "there_digest", "digest")).drop("target", "there_bytes", "there_digest")


def round_trip(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write pages as archives and read their assembled captures back."""
    write_archives(pages, path, **columns)
    records = materialize(read_archives(pages.sparkSession, path), "records")
    return resolved(transactions(records))
