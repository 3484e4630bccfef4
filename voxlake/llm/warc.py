"""WARC derivatives: metadata and conversion records from HTTP responses, in DataFrame functions.

A response is known by url, HTTP header lines and payload. Each yields two WARC/1.1 records that name it:
metadata (application/warc-fields: title, number of links, links) and conversion (plain text). Both carry
WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date of the response, each of its HTTP header lines in a
field X-Source-Http-Headers, its payload digest under X-Source-Payload-Digest, and a digest of their own
block. Record ids are derived from what a record is made of, so a rerun makes the same records.

Patterns run in time proportional to a page: a tag holds no other `<`, and a script, style, comment or title that is
not closed reaches to the page's end.

Defined cases: null url and html are empty; line ends in a url become spaces, those in a link are left out, empty header
lines are left out; a page of any length is one record; repeated rows make repeated records; an empty table makes none.
Other columns are kept, but for those named like a column of the result, whatever their case, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: "
OUTPUT = ("record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "record")

# The steps from HTML to plain text, as (pattern, replacement).
_STEPS = (
    (r"(?is)<(script|style)[^<>]*>(?:.*?</(script|style)[^<>]*>|.*\z)", " "),
    (r"(?s)<!--(?:.*?-->|.*\z)", " "),
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|title|body|head)[^<>]*>", "\n"),
    (r"<[^<>]*>", ""),
)
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
_TITLE, _LINK = r"(?is)<title[^<>]*>(.*?)(?:</title>|\z)", r'(?i)<a\s[^<>]*href="([^"]*)"'


def plain_text(html: Column) -> Column:
    for pattern, to in _STEPS:
        html = F.regexp_replace(html, pattern, to)
    for entity, to in _ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    for pattern, to in _SPACES:
        html = F.regexp_replace(html, pattern, to)
    return html


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def derive(responses: DataFrame, date: str = DATE) -> DataFrame:
    """responses(url, http_headers, payload, ...) -> a row per derived record: the other columns and record_type,
    record_id, refers_to, target_uri, source_digest, block_digest, record (the whole record as a string)."""
    keep = [c for c in responses.columns if c.lower() not in ("url", "http_headers", "payload", *OUTPUT)]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = responses.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"), F.regexp_replace(text("url"), "[\r\n]", " ").alias("target_uri"), text("http_headers").alias("http_headers"), text("payload").alias("payload"))
    r = r.withColumn("source_digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    r = r.withColumn("refers_to", _urn(F.lit("response"), F.lit(date), F.col("target_uri"), F.col("source_digest")))
    links = F.transform(F.regexp_extract_all("payload", F.lit(_LINK), 1), lambda x: F.regexp_replace(x, "[\r\n]", ""))
    title = F.regexp_replace(F.regexp_extract("payload", _TITLE, 1), r"\s+", " ")
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlinks: "), F.size(links).cast("string"), F.lit("\r\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))
    two = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("kind"), fields.alias("block")), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("kind"), plain_text(F.col("payload")).alias("block")))
    headers = F.filter(F.split("http_headers", "[\r\n]+"), lambda x: F.trim(x) != "")
    header_fields = F.array_join(F.transform(headers, lambda x: F.concat(F.lit("X-Source-Http-Headers: "), x, F.lit("\r\n"))), "")
    out = r.select("kept", "target_uri", header_fields.alias("header_fields"), "source_digest", "refers_to", F.inline(two))
    out = out.withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))).withColumn("record_id", _urn(F.col("record_type"), F.col("refers_to"), F.col("block_digest")))
    line = lambda name, value: F.concat(F.lit(name), value, F.lit("\r\n"))
    lines = [
        line("WARC-Type: ", F.col("record_type")), line("WARC-Record-ID: ", F.col("record_id")), line("WARC-Date: ", F.lit(date)), line("WARC-Target-URI: ", F.col("target_uri")), line("WARC-Refers-To: ", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI: ", F.col("target_uri")), line("WARC-Refers-To-Date: ", F.lit(date)), line("WARC-Block-Digest: ", F.col("block_digest")), line("X-Source-Payload-Digest: ", F.col("source_digest")),
        F.col("header_fields"), line("Content-Type: ", F.col("kind")), line("Content-Length: ", _bytes(F.col("block"))),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))
    kept = [F.col("kept")[c].alias(c) for c in keep]
    return out.select(*kept, *OUTPUT[:-1], F.concat(head, F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def read_responses(records: DataFrame) -> DataFrame:
    """Records(record string) of WARC response records -> url, http_headers, payload, the rows that derive takes, and
    all other columns but those of these names; records of other types are left out."""
    keep = [c for c in records.columns if c.lower() not in ("record", "url", "http_headers", "payload")]
    after = lambda c, mark: F.substring(c, F.instr(c, mark) + len(mark), F.length(c))
    before = lambda c, mark: F.substring(c, F.lit(1), F.instr(c, mark) - 1)
    gap = "\r\n\r\n"
    r = records.where(F.instr("record", gap) > 0).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"), before(F.col("record"), gap).alias("head"), after(F.col("record"), gap).alias("block"))
    r = r.where(F.lower(F.trim(F.regexp_extract("head", r"(?im)^WARC-Type:([^\r\n]*)", 1))) == "response")
    r = r.withColumn("block", F.regexp_replace("block", r"\r\n\r\n\z", ""))  # what ends a record
    whole = F.when(F.instr("block", gap) > 0, F.col("block")).otherwise(F.concat("block", F.lit(gap)))
    r = r.withColumn("block", whole)
    return r.select(*[F.col("kept")[c].alias(c) for c in keep], F.trim(F.regexp_extract("head", r"(?im)^WARC-Target-URI:([^\r\n]*)", 1)).alias("url"), before(F.col("block"), gap).alias("http_headers"), after(F.col("block"), gap).alias("payload"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    responses = load(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit(HTTP), _bytes(html)).alias("http_headers"), html.alias("payload"))
    done = derive(responses)
    return done.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def _sql_text() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    code = lambda s: q(s).replace("\n", "' || chr(10) || '")
    out = "payload"
    for pattern, to in _STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {code(to)}, 'g')"
    for entity, to in _ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(to)})"
    for pattern, to in _SPACES:
        out = f"regexp_replace({out}, {q(pattern)}, {code(to)}, 'g')"
    return out


OP8_SQL = f"""
WITH r AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, '{HTTP}' || strlen(payload) AS http_headers, 'sha256:' || sha256(payload) AS source_digest FROM r),
i AS (SELECT *, md5('response|{DATE}|' || target_uri || '|' || source_digest) AS h, list_transform(regexp_extract_all(payload, '{_LINK}', 1), lambda x: regexp_replace(x, '[\\r\\n]', '', 'g')) AS links FROM s),
t AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to FROM i),
b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS kind,
    'title: ' || regexp_replace(regexp_extract(payload, '{_TITLE}', 1), '\\s+', ' ', 'g') || chr(13) || chr(10) || 'links: ' || len(links) || chr(13) || chr(10)
    || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || chr(13) || chr(10)), ''), '') AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text()} FROM t),
d AS (SELECT *, 'sha256:' || sha256(block) AS block_digest FROM b),
k AS (SELECT *, md5(record_type || '|' || refers_to || '|' || block_digest) AS g FROM d),
n AS (SELECT *, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] || '>' AS record_id, chr(13) || chr(10) AS nl FROM k),
w AS (SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: {DATE}' || nl || 'WARC-Target-URI: ' || target_uri || nl
  || 'WARC-Refers-To: ' || refers_to || nl || 'WARC-Refers-To-Target-URI: ' || target_uri || nl || 'WARC-Refers-To-Date: {DATE}' || nl || 'WARC-Block-Digest: ' || block_digest || nl
  || 'X-Source-Payload-Digest: ' || source_digest || nl || 'X-Source-Http-Headers: ' || http_headers || nl || 'Content-Type: ' || kind || nl || 'Content-Length: ' || strlen(block) || nl || nl || block || nl || nl AS record FROM n)
SELECT page_id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, strlen(record) AS record_bytes, sha256(record) AS record_sha256 FROM w
"""
