"""WARC records and the resolution of not-modified revisits.

A revisit stands for a page that had not changed: it holds headers but no body.  It is
resolved by an as-of join on the canonical URL to the latest earlier full response; the
validators of both (ETag, else Last-Modified, else payload digest) must agree, and the
header fields that a not-modified answer may change are merged over the stored ones.

The as-of join carries the latest response of each slice of time over the slices, and
within a slice over its records, so that a URL with very many captures is spread over
tasks.  Slices are ranges of (time, record id) with about equal numbers of captures, so that
neither an odd time nor a burst at one time fills one of them.

Defined cases
  * a revisit without an earlier full response is "unresolved", one whose validators
    disagree "mismatch", one without a validator in common "unverified"; all are kept;
  * captures of one URL and one time follow each other by record id; captures without a URL
    or a time match nothing: such revisits are "unresolved"; null header maps count as empty; header names are compared in lower case;
  * an empty table gives an empty result; of repeated responses the one of the greatest
    record id counts.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLICES = 64
#: Fixed by RFC 9110 and 9111: fields of the connection and of the stored body, which a
#: not-modified answer must not change.
KEPT_FIELDS = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
    "content-encoding", "content-length", "content-range", "content-type",
]
#: Query parameters that tell where a visitor came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default ports, no scheme, fragment, tracking
    parameters or closing slash; parameters in order."""
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(whole, r"^(?i)https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header map with names in lower case; of names that clash the last in order holds."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    names = F.transform(pairs, lambda p: F.lower(p["key"]))
    last = lambda p, i: i == F.size(names) - F.array_position(F.reverse(names), F.lower(p["key"]))
    kept = F.filter(pairs, last)
    return F.map_from_arrays(F.transform(kept, lambda p: F.lower(p["key"])), F.transform(kept, lambda p: p["value"]))


def resolve_revisits(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row for each revisit.  ``captures``: record_id long, url string, ts long, kind
    ("response" or "revisit"), status int, headers map, payload_digest string,
    payload_length long."""
    rows = captures.select("record_id", "url", "ts", "kind", "status", _lowered(F.col("headers")).alias("headers"), "payload_digest", "payload_length", canonical_url(F.col("url")).alias("canonical"))
    full = F.struct("ts", "record_id", "status", "headers", "payload_digest", "payload_length")
    rows = rows.withColumn("full", F.when(F.col("kind") == "response", full))
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    empty = F.lit(None).cast(rows.schema["full"].dataType)
    alone = rows.where(~known & (F.col("kind") == "revisit")).drop("full").withColumn("base", empty)
    # the ranges are those of one written table, whatever is computed again later
    ranged = rows.where(known & F.col("kind").isin("response", "revisit")).repartitionByRange(slices, "ts", "record_id")
    sliced = written(ranged.withColumn("slice", F.spark_partition_id()), "captures")
    order = Window.partitionBy("canonical", "slice").orderBy("ts", "record_id")
    inner = sliced.withColumn("before", F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'revisit'").drop("full")
    latest = sliced.where("full is not null").groupBy("canonical", "slice").agg(F.max_by("full", F.struct("ts", "record_id")).alias("latest"))
    # a slice takes what the last slice before it with a response has: at most ``slices`` rows for each URL
    asked = sliced.where("full is null").select("canonical", "slice").distinct().withColumn("latest", empty)
    both = latest.unionByName(asked).groupBy("canonical", "slice").agg(F.first("latest", ignorenulls=True).alias("latest"))
    carried = both.withColumn("carried", F.last("latest", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).where("carried is not null").drop("latest")
    found = inner.join(carried, ["canonical", "slice"], "left").withColumn("base", F.coalesce("before", "carried")).select(*alone.columns).unionByName(alone)

    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    checks = [(weak(F.col("headers")["etag"]), weak(F.col("base.headers")["etag"])), (F.col("headers")["last-modified"], F.col("base.headers")["last-modified"]), (F.col("payload_digest"), F.col("base.payload_digest"))]
    agree = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in checks])
    outcome = F.when(F.col("base").isNull(), "unresolved").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    allowed = F.map_filter("headers", lambda k, _: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter("base.headers", lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    good = F.col("outcome") == "resolved"
    out = found.withColumn("outcome", outcome)
    return out.select(
        "record_id", "url", F.col("canonical").alias("canonical_url"), "ts", "outcome", F.col("base.record_id").alias("response_id"), F.when(good, F.col("base.status")).alias("status"),
        F.when(good, merged).alias("headers"), F.when(good, F.col("base.payload_digest")).alias("payload_digest"), F.when(good, F.col("base.payload_length")).alias("payload_length"),
    )


def resolved_records(captures: DataFrame, **options) -> DataFrame:
    """The resolved revisits as full records, with the payload of their response.
    ``captures`` has a binary payload too; payloads move only to the revisits they serve."""
    found = resolve_revisits(captures, **options).where("outcome = 'resolved'")
    bodies = captures.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "payload")
    return found.join(bodies, "response_id")


def _parse_block(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return lines[0], fields


def parse_warc(data: bytes):
    """The records of a WARC file, plain or gzip by record: WARC headers, and for HTTP
    records status, headers and payload."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    stream = io.BytesIO(data)
    while True:
        at = stream.tell()
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        first, fields = _parse_block(data[at:end].lstrip(b"\r\n"))
        if not first.startswith("WARC/"):
            return
        length = int(fields.get("content-length", 0))
        block = data[end + 4 : end + 4 + length]
        stream.seek(end + 4 + length)
        while data[stream.tell() : stream.tell() + 2] == b"\r\n":
            stream.seek(2, 1)
        status, headers, payload = None, {}, block
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            line, headers = _parse_block(head)
            parts = line.split(" ", 2)
            status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
        yield {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "warc_headers": fields, "status": status, "headers": headers, "payload": payload}


def format_record(warc_type: str, record_id: str, url: str, date: str, status: int | None, headers: dict[str, str], payload: bytes, compress: bool = True) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own unless told otherwise."""
    http = f"HTTP/1.1 {status or 200} \r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in sorted(headers.items())) + b"\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {warc_type}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    record = head.encode() + http + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compress else record


WARC_SCHEMA = "warc_type string, record_id string, url string, date string, warc_headers map<string,string>, status int, headers map<string,string>, payload binary"


def read_warc(spark, path: str) -> DataFrame:
    """The records of all WARC files under a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(parse_warc(data))
                if rows:
                    kinds = {"warc_headers": pa.map_(pa.string(), pa.string()), "headers": pa.map_(pa.string(), pa.string()), "status": pa.int32(), "payload": pa.binary()}
                    pick = lambda c: [list(r[c].items()) if isinstance(r[c], dict) else r[c] for r in rows]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(pick(c), kinds.get(c, pa.string())) for c in rows[0]], list(rows[0]))

    return files.mapInArrow(run, WARC_SCHEMA)


def page_captures(pages: DataFrame) -> DataFrame:
    """The crawl that ``pages`` stands for: a full response for each page at the time of its
    id, and some time after it, between those of other pages, a second visit that answers
    not-modified.  Every seventh page has no ETag, and every eleventh visit brings neither
    that nor a date."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("length"))
    p = F.col("page_id")
    etag = F.when(p % 7 != 0, F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    both = base.select("*", etag.alias("etag"), F.concat(F.lit("day "), F.floor(p / 10).cast("string")).alias("day"), F.explode(F.array(F.lit("response"), F.lit("revisit"))).alias("kind"))
    again, bare = F.col("kind") == "revisit", p % 11 == 0
    fields = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    first = fields(("ETag", F.col("etag")), ("Last-Modified", F.col("day")), ("Content-Type", F.lit("text/html")), ("Content-Length", F.col("length").cast("string")), ("Cache-Control", F.lit("max-age=60")))
    second = fields(("etag", F.when(~bare, F.concat(F.lit("W/"), F.col("etag")))), ("last-modified", F.when(~bare, F.col("day"))), ("Content-Length", F.lit("0")), ("Cache-Control", F.lit("max-age=600")), ("Connection", F.lit("close")))
    return both.select(
        (p * 2 + again.cast("long")).alias("record_id"), "url", (p + F.when(again, p * 7919 % 1009).otherwise(0)).alias("ts"), "kind",
        F.when(again, 304).otherwise(200).alias("status"), F.when(again, second).otherwise(first).alias("headers"), F.when(~again, F.col("digest")).alias("payload_digest"), F.when(~again, F.col("length")).alias("payload_length"),
    )


def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    none = F.lit(-1).cast("long")  # in place of a missing number
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda p: F.concat(p["key"], F.lit(": "), p["value"]))
    return found.select(
        F.expr("record_id div 2").alias("page_id"), "canonical_url", "outcome", F.coalesce(F.expr("response_id div 2"), none).alias("response_page_id"), F.coalesce("status", none.cast("int")).alias("status"),
        F.array_join(lines, "\n").alias("headers"), "payload_digest", F.coalesce("payload_length", none).alias("payload_length"),
    )


OP8_SQL = r"""
WITH b AS (
  SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, sha256(coalesce(html, '')) AS digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS n
  FROM pages
), s AS (SELECT *, regexp_replace(u, '^https?://', '', 'i') AS bare FROM b),
p AS (
  SELECT page_id, digest, n,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)'))) AS q
  FROM s
), c AS (SELECT page_id, digest, n, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM p),
r AS (
  SELECT *, CASE WHEN page_id % 7 <> 0 THEN '"' || digest[1:16] || '"' END AS etag, 'day ' || CAST(page_id // 10 AS VARCHAR) AS day,
    page_id * 4294967296 + page_id * 2 AS at, (page_id + page_id * 7919 % 1009) * 4294967296 + page_id * 2 + 1 AS again, page_id % 11 = 0 AS bare FROM c
), j AS (
  SELECT v.page_id, v.canonical_url, d.page_id AS base, d.digest, d.n, d.etag AS old_tag, d.day AS old_day, CASE WHEN NOT v.bare THEN v.etag END AS new_tag, CASE WHEN NOT v.bare THEN v.day END AS new_day
  FROM r AS v ASOF LEFT JOIN (SELECT * FROM r WHERE canonical_url IS NOT NULL) AS d ON v.canonical_url = d.canonical_url AND v.again > d.at
), o AS (
  SELECT *, CASE WHEN base IS NULL THEN 'unresolved' WHEN new_tag = old_tag OR (new_tag IS NULL OR old_tag IS NULL) AND new_day = old_day THEN 'resolved'
    WHEN new_tag IS NOT NULL AND old_tag IS NOT NULL OR new_day IS NOT NULL THEN 'mismatch' ELSE 'unverified' END AS outcome FROM j
)
SELECT page_id, canonical_url, outcome, coalesce(base, -1) AS response_page_id,
  CASE WHEN outcome = 'resolved' THEN CAST(200 AS INTEGER) ELSE CAST(-1 AS INTEGER) END AS status,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || CAST(n AS VARCHAR) || chr(10) || 'content-type: text/html'
    || CASE WHEN new_tag IS NOT NULL THEN chr(10) || 'etag: W/' || new_tag WHEN old_tag IS NOT NULL THEN chr(10) || 'etag: ' || old_tag ELSE '' END || chr(10) || 'last-modified: ' || coalesce(new_day, old_day) END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN n ELSE CAST(-1 AS BIGINT) END AS payload_length
FROM o
"""
