"""WARC archives: written from pages, read back, and assembled to one nested row per capture.

Writing: every page is a request, a response or revisit, and a metadata record, bound by ``WARC-Concurrent-To``; the archives are gzip files of
Spark's own text writer (the four bytes that end a WARC record are its line separator), so they lie in any store Spark writes to.
Reading: archives are parsed as streams, by ``Content-Length``, gzip members or plain.  Assembly: records are joined through their
concurrent-to identifiers in either direction and over several hops, until no record gains a capture.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import stored

#: payloads from this size on are written once and then revisited
LEAST_REVISITED = 100
#: records an archive holds at most; original payloads that are broadcast at most; parts of one kind a capture row holds on average at most
ARCHIVE_RECORDS, BROADCAST_ROWS, NEST = 6000, 100_000, 1000
#: fixed value of the WARC standard
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ANCHORS = ("response", "revisit", "resource")

RECORDS = ("record_id string, kind string, target_uri string, date string, concurrent_to array<string>, refers_to string, declared_digest string, head string, "
           "payload binary, payload_bytes long, payload_sha256 string, error string")


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    """A record without its closing empty lines; ``more`` are further header lines (null: none)."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {content_type}"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``.

    The payload is the html in UTF-8 (null: empty).  Of payloads of at least ``LEAST_REVISITED`` bytes that are equal, the row with the smallest page_id
    is the response and the others are revisits without payload; rows that repeat that page_id are responses too.  A null page_id counts as
    largest and is read back as null; a null url is written as an empty one, white space and control characters in it per cent.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"),
                        F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    # only payloads that occur more than once need a join, and a join by digest alone
    firsts = stored(rows.where(F.col("size") >= LEAST_REVISITED).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
                    .select("digest", "first_id", F.lit(True).alias("copied")), "warc-firsts")
    few = firsts.count() <= BROADCAST_ROWS
    both = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    again = F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    page, serial = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")
    named = both.select("html", "digest", "size", page.alias("page"), uri.alias("uri"), again.alias("again"), serial.alias("serial"))
    ids = {k: _uuid(F.lit(k), "page", "digest", "serial") for k in ("request", "response", "metadata")}
    beside = F.concat(F.lit("WARC-Concurrent-To: "), ids["response"])
    host, target = F.regexp_extract("uri", r"://([^/?#]*)", 1), F.regexp_extract("uri", r"^(?:[^:]*://)?[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"),
                      F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    records = named.select(F.explode(F.array(
        _record("request", ids["request"], F.col("uri"), "application/http;msgtype=request", ask, beside),
        _record(F.when(F.col("again"), "revisit").otherwise("response"), ids["response"], F.col("uri"), "application/http;msgtype=response", answer,
                F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"), F.when(F.col("again"), F.lit(f"WARC-Profile: {IDENTICAL}"))),
        _record("metadata", ids["metadata"], F.col("uri"), "application/warc-fields", F.concat(F.lit("page-id: "), "page", F.lit("\r\n")), beside))).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parsed(stream: io.BufferedIOBase, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive.  A damaged record gives a row that says so in ``error`` and ends the archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        row: dict = dict.fromkeys(("record_id", "kind", "target_uri", "date", "refers_to", "declared_digest", "head", "payload", "payload_bytes", "payload_sha256", "error")) | {"concurrent_to": []}
        if not line.startswith(b"WARC/"):
            yield row | {"kind": "damaged", "error": "no version line"}
            return
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                row["concurrent_to"].append(value)
            headers[name] = value
        length = headers.get("content-length", "")
        block = stream.read(int(length)) if length.isdigit() else b""
        row |= {"record_id": headers.get("warc-record-id"), "kind": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                "refers_to": headers.get("warc-refers-to"), "declared_digest": headers.get("warc-payload-digest")}
        if not length.isdigit() or len(block) < int(length):
            yield row | {"kind": "damaged", "error": "cut short" if length.isdigit() else "no length"}
            return
        head, payload = b"", block
        if headers.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head, payload = (block, b"") if cut < 0 else (block[:cut], block[cut + 4:])
        elif headers.get("content-type", "").startswith("application/warc-fields"):
            head, payload = block, b""
        digest = hashlib.sha256(payload).hexdigest() if row["kind"] in ("response", "resource") else None
        said = row["declared_digest"] or ""
        wrong = digest is not None and said.startswith("sha256:") and len(said) == 71 and said[7:].lower() != digest
        yield row | {"head": head.decode("utf-8", "replace"), "payload": payload if payloads else None, "payload_bytes": len(payload), "payload_sha256": digest,
                     "error": "payload does not have the declared digest" if wrong else None}


class _Unzipped(io.RawIOBase):
    """Gzip members of a buffer as one stream, inflated as it is read."""

    def __init__(self, data: memoryview) -> None:
        self._data, self._at, self._inflate, self._rest = data, 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self._inflate.eof:
                self._rest = self._inflate.unused_data or self._rest
                if not self._rest and self._at >= len(self._data):
                    return 0
                self._inflate = zlib.decompressobj(31)
            if not self._rest and self._at < len(self._data):
                self._rest = bytes(self._data[self._at:self._at + (1 << 18)])
                self._at += len(self._rest)
            more = self._inflate.decompress(self._rest, len(target))
            self._rest = self._inflate.unconsumed_tail or (self._inflate.unused_data if self._inflate.eof else b"")
            if more:
                target[:len(more)] = more
                return len(more)
            if not self._rest and self._at >= len(self._data):
                return 0


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below ``path`` (columns ``RECORDS``); without ``payloads`` only their sizes and digests.

    An archive is held as stored, never inflated as a whole; what is inflated are single records.  Empty archives give no rows.
    """
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())),
                        ("refers_to", pa.string()), ("declared_digest", pa.string()), ("head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_sha256", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                stream = io.BufferedReader(_Unzipped(data), 1 << 18) if bytes(data[:2]) == b"\x1f\x8b" else io.BytesIO(data)
                rows, held = [], 0
                try:
                    for row in parsed(stream, payloads):
                        rows.append(row)
                        held += 500 + len(row["payload"] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                except (zlib.error, EOFError) as error:
                    rows.append({"kind": "damaged", "error": str(error), "concurrent_to": []})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def capture_of(records: DataFrame) -> DataFrame:
    """(record_id, capture) of every record that hangs together with a response, revisit or resource by concurrent-to identifiers.

    Identifiers count in both directions and over any number of hops, one join round a hop; an anchor is its own capture, another record
    takes the smallest capture among those nearest to it.
    """
    links = records.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id is not null")
    edges = links.union(links.select("other", "record_id"))
    found = [records.where(F.col("kind").isin(*ANCHORS)).select("record_id", F.col("record_id").alias("capture"))]
    while True:
        known = found[0]
        for more in found[1:]:
            known = known.union(more)
        near = edges.join(found[-1].withColumnRenamed("record_id", "other"), "other").select("record_id", "capture")
        reached = stored(near.join(known.select("record_id"), "record_id", "left_anti").groupBy("record_id").agg(F.min("capture").alias("capture")), "warc-reached")
        if reached.isEmpty():
            return known
        found.append(reached)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, part, target_uri, date, response (kind, refers_to, declared_digest, head, payload, payload_bytes, payload_sha256),
    requests and metadata (arrays of record_id and head).

    Request and metadata records without a capture form rows of their own without a response.  A capture with more than ``NEST`` such
    records comes in several parts, of which only part 0 holds the response, so no row grows without bound.  A response without an
    identifier takes no part.  Records of other kinds (warcinfo, damaged ones) belong to no capture.
    """
    parts = records.where(F.col("kind").isin("request", "metadata") & F.col("record_id").isNotNull()).select("record_id", "kind", "head", "target_uri", "date")
    placed = parts.join(capture_of(records), "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    shares = placed.groupBy("capture").agg(F.ceil(F.count("*") / NEST).alias("shares")).where("shares > 1")
    dealt = placed.join(shares, "capture", "left").withColumn("part", F.when(F.col("shares") > 1, F.pmod(F.xxhash64("record_id"), F.col("shares"))).otherwise(F.lit(0)).cast("int"))
    one = F.struct("record_id", "head")
    nested = dealt.groupBy("capture", "part").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "request", one))).alias("requests"), F.sort_array(F.collect_list(F.when(F.col("kind") == "metadata", one))).alias("metadata"),
        F.min("target_uri").alias("part_uri"), F.min("date").alias("part_date"))
    answers = records.where(F.col("kind").isin(*ANCHORS) & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("capture"), F.lit(0).alias("part"), "target_uri", "date",
        F.struct("kind", "refers_to", "declared_digest", "head", "payload", "payload_bytes", "payload_sha256").alias("response"))
    nothing = F.array().cast("array<struct<record_id:string,head:string>>")
    return answers.join(nested, ["capture", "part"], "full").select(
        "capture", "part", F.coalesce("target_uri", "part_uri").alias("target_uri"), F.coalesce("date", "part_date").alias("date"), "response",
        F.coalesce("requests", nothing).alias("requests"), F.coalesce("metadata", nothing).alias("metadata"))


def originals(captures: DataFrame) -> DataFrame:
    """(capture, original) of every revisit: the capture it refers to, or else the smallest response capture with the same payload digest (null if there is none)."""
    answers = captures.where("response is not null").select("capture", "response.kind", "response.refers_to", "response.declared_digest", "response.payload_sha256")
    by_digest = answers.where("kind <> 'revisit' and payload_sha256 is not null").groupBy(F.concat(F.lit("sha256:"), "payload_sha256").alias("declared_digest")).agg(F.min("capture").alias("equal"))
    return answers.where("kind = 'revisit'").select("capture", "refers_to", "declared_digest").join(by_digest, "declared_digest", "left").select(
        "capture", F.coalesce("refers_to", "equal").alias("original"))


SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as size, sha256(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by digest) as first_id from p)
select page_id, size::bigint as payload_bytes, digest as payload_digest,
       case when size < {LEAST_REVISITED} or page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
       case when size < {LEAST_REVISITED} or page_id is not distinct from first_id then null else first_id end as refers_to
from f"""
