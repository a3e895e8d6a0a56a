"""WARC archives: write a transaction for each page, read archives back, assemble transactions.

A capture is a response (or a revisit of an equal payload), a request and a metadata record; the latter two name the
first by WARC-Concurrent-To. Archives are written with Spark's text sink, whose line separator is the end of a record,
so that any store and any lost task is as safe as for other tables. Pages are written by classes of their size, each
with as many pages in a file as make some 32 MB at most, and a page beyond 2 MB alone. Archives are read once, as whole
files, by Content-Length.

Defined results: a null html is an empty payload; pages whose id is null are written and come back with a null id, and
are never the original of another page if one has an id; rows that repeat the smallest id of a payload are responses
too; records that name no capture, or a missing one, give no row; of several requests or metadata records of a capture
the one with the smallest record id counts, and of several captures of one id the least one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm.common import cut, lean, scratch

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of fewer bytes are stored each time.
LEAST_REVISIT = 100
LAST = 2**63 - 1
#: Payloads of fewer bytes than the first number go into files of so many pages; larger ones are alone in theirs.
CLASSES = ((1 << 16, 500), (1 << 21, 16))


def _record_id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _headers(*pairs: tuple[str, Column | str | None]) -> Column:
    """Header lines; null values leave their line out."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v))
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *[line(k, v) for k, v in pairs])


def _safe(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the transactions of ``pages`` (page_id, url, html) as compressed WARC files in folders below ``path``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = lean(pages).select("page_id", _safe(F.col("url")).alias("url"), body.alias("html"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha2("html", 256), "size": F.octet_length("html")})
    order = F.struct(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page"), "row")
    firsts = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    # stored first: then the join below deals out both sides itself, and may split a payload that a third of the pages have
    firsts = cut(firsts.where("n > 1").select("digest", "first"))
    rows = rows.join(firsts, "digest", "left")
    revisit = F.coalesce((F.col("first.page") != F.coalesce(F.col("page_id").cast("long"), F.lit(LAST))) & F.col("first").isNotNull(), F.lit(False))
    rows = rows.withColumn("revisit", revisit)
    own, original = _record_id("response", F.col("row")), _record_id("response", F.col("first.row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"^.*?://[^/?#]*", ""), F.lit("")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.when(F.col("revisit"), F.concat(F.lit("refersToPage: "), F.nullif(F.col("first.page"), F.lit(LAST)).cast("string"))), F.lit("via: crawl"))
    length = lambda x: F.octet_length(x).cast("string")
    common = (("WARC-Date", DATE), ("WARC-Target-URI", F.col("url")))
    capture = _headers(
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", own), *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        ("WARC-Refers-To", F.when(F.col("revisit"), original)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length(block)),
    )
    request = _headers(("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", length(asked)))
    metadata = _headers(("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields"), ("Content-Length", length(fields)))
    records = F.array(*[F.concat(h, F.lit(END), b) for h, b in ((capture, block), (request, asked), (metadata, fields))])
    least = 0
    for most, many in (*CLASSES, (LAST, 1)):
        own = rows.where((F.col("size") >= least) & (F.col("size") < most)).select(F.explode(records).alias("value"))
        own.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * many).text(f"{path}/from-{least}")
        least = most


RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, fields map<string,string>, payload binary"


def _parsed(raw: bytes | bytearray) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with lower-cased names, and block of each record."""
    at = 0
    while (end := raw.find(b"\r\n\r\n", at)) >= 0:
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin where the last one ended")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, bytes(raw[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def _field_lines(raw: bytes) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")) if s]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``; digests and sizes are those of the payload itself where it is stored.

    A revisit has the digest and the size that its headers give. ``payloads``: also return the stored payloads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                raw = raw.as_py()
                data = zlib.decompressobj(47)
                whole = bytearray()
                while raw:  # members follow one another
                    whole += data.decompress(raw)
                    raw = data.unused_data
                    data = zlib.decompressobj(47)
                yield from records(whole)

    def records(raw: bytearray) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for headers, block in _parsed(raw):
            kind = headers.get("warc-type")
            payload, digest, length, fields = None, headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, None, []
            if kind in ("response", "revisit"):
                head, _, rest = block.partition(b"\r\n\r\n")
                fields = _field_lines(head)
                if kind == "response":
                    payload, digest, length = rest, hashlib.sha256(rest).hexdigest(), len(rest)
                else:
                    length = next((int(v) for k, v in fields if k.lower() == "content-length"), None)
            elif kind == "request":
                fields = _field_lines(block)
            elif kind == "metadata":
                fields = _field_lines(block)
            rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, length, fields, payload if payloads else None))
            size += len(block)
            if size > 8_000_000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * 6, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        fields = [list({k: v for k, v in r[7]}.items()) for r in rows]
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[7] = fields
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs), n_requests, n_metadata.

    Records meet by the id of the capture that they belong to, and the archives are read once. What is kept of a capture
    is a bounded aggregate, so a capture that very many records name does not gather them in one place.
    """
    capture = F.col("type").isin("response", "revisit")
    kinds = {"response": capture, "request": F.col("type") == "request", "metadata": F.col("type") == "metadata"}
    small = F.struct("record_id", "uri", F.map_entries("fields").alias("fields"))
    whole = F.struct("record_id", "type", "uri", "refers_to", "digest", "payload_bytes", F.map_entries("fields").alias("fields"), "payload")
    rows = records.select(F.when(capture, F.col("record_id")).when(kinds["request"] | kinds["metadata"], F.col("concurrent_to")).alias("capture_id"), "type", small.alias("small"), F.when(capture, whole).alias("whole"))
    pick = lambda t: F.min(F.when(kinds[t], F.col("whole" if t == "response" else "small"))).alias(t)
    one = rows.where("capture_id is not null").groupBy("capture_id").agg(
        *[pick(t) for t in kinds], F.count_if(kinds["request"]).alias("n_requests"), F.count_if(kinds["metadata"]).alias("n_metadata")
    )
    opened = lambda c, names: F.when(F.col(c).isNotNull(), F.struct(*[F.map_from_entries(f"{c}.fields").alias(n) if n == "fields" else F.col(f"{c}.{n}").alias(n) for n in names])).alias(c)
    of = {"response": ("record_id", "type", "uri", "refers_to", "digest", "payload_bytes", "fields", "payload")}
    return one.where("response is not null").select("capture_id", *[opened(c, of.get(c, ("record_id", "uri", "fields"))) for c in kinds], "n_requests", "n_metadata")


def archive_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from archives written and read back."""
    path = scratch(pages.sparkSession)
    write_archives(pages, path)
    captures = assemble(read_archives(pages.sparkSession, path, payloads=False))
    ids = pages.schema["page_id"].dataType
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast(ids)
    return captures.select(
        field("pageId").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), field("refersToPage").alias("refers_to"),
    )
