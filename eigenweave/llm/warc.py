"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

Each response yields a ``metadata`` record (warc-fields: source record, its payload digest, status, content type,
title, outlinks' count, then every WARC and HTTP header of the source as it stands) and a ``conversion`` record (the page as plain
text). Both name the response in WARC-Refers-To and carry its target URI and date, and the source's own payload digest where it has
one; block digests are ``sha256:``. Everything is a projection of the response row: no shuffle.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import html
import html.entities
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Matches of these, in order, are replaced; the same expressions run in Java and RE2.
_UNSEEN = r"(?is)<(?:!--(?:.*?-->|.*)|" + "|".join(rf"{t}(?:[\s/][^>]*)?>(?:.*?</{t}\s*>|.*)" for t in ("script", "style", "template")) + r"|title(?:[\s/][^>]*)?>[^<]*(?:</title\s*>)?)"
_BREAK = r"(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|section|article|header|footer|nav|main|blockquote|pre|form|head|body|html)(?:[\s/][^>]*)?>"
_TAG = r"<[!/?a-zA-Z][^>]*>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Named references of HTML 4, and &apos;. A no-break space is a space here.
_NAMED = {k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'", "nbsp": " "}
#: What browsers take numbers 128 to 159 for.
_WINDOWS = [bytes([k]).decode("cp1252", "replace") for k in range(128, 160)]
_SPACES, _LINES = r" [ \t\r\f\x0B]+|[\t\r\f\x0B][ \t\r\f\x0B]*", r" ?\n[ \n]*"
_TITLE = r"(?is)<title(?:[\s/][^>]*)?>([^<]*)"
_LINK = r"(?i)<a\s[^>]*href"
_HEADERS = "array<struct<name:string,value:string>>"


def record_id(*parts: Column) -> Column:
    """A stable urn:uuid from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def decoded(text: Column) -> Column:
    """Character references replaced, once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in sorted(_NAMED.items()) for x in pair])
    windows = F.array(*[F.lit(x) for x in _WINDOWS])

    def plain(code: Column) -> Column:
        number = F.when(F.lower(F.substring(code, 3, 1)) == "x", F.conv(F.substr(code, F.lit(4), F.length(code) - 4), 16, 10)).otherwise(F.substr(code, F.lit(3), F.length(code) - 3)).try_cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        by_number = F.when(bad, "\ufffd").when(number == 160, " ").when(number.between(128, 159), F.get(windows, number - 128)).otherwise(wide)
        return F.when(F.substring(code, 2, 1) == "#", by_number).otherwise(F.coalesce(F.element_at(names, F.substr(code, F.lit(2), F.length(code) - 2)), code))

    codes = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), plain)
    whole = F.array_join(F.zip_with(F.split(text, _ENTITY, -1), F.concat(codes, F.array(F.lit(""))), lambda piece, code: F.concat(piece, code)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def plain_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles, templates (to the end if never closed) and titles removed, block tags broken into lines, character references decoded."""
    t = F.regexp_replace(html, _UNSEEN, " ")
    t = decoded(F.regexp_replace(F.regexp_replace(t, _BREAK, "\n"), _TAG, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, _SPACES, " "), _LINES, "\n"), F.lit(" \n"))


def one_line(value: Column) -> Column:
    """A header's value: null is empty, line breaks are spaces."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "\r\n", "  ")


def _lines(prefix: str, headers: Column) -> Column:
    """Headers, in order, as warc-fields; null is none."""
    lines = F.transform(headers, lambda h: F.concat(F.lit(prefix), one_line(h["name"]), F.lit(": "), one_line(h["value"]), F.lit(CRLF)))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Fetched pages as response records like those of `read_warc`, with page_id. Nulls are empty.

    The id is made of the page's id, address and content: rows equal in all three are one record, repeated, and keep one id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = "text/html; charset=utf-8"
    http = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit(kind).alias("value")))
    return pages.select(F.col(id_col).alias("page_id"), F.lit("response").alias("warc_type"), record_id(F.lit("response"), text(id_col), text(url_col), digest(text(html_col))).alias("record_id"), text(url_col).alias("target_uri"), F.lit(date).alias("date"),
                        F.lit(200).alias("status"), F.lit(kind).alias("content_type"), F.array().cast(_HEADERS).alias("headers"), http.alias("http_headers"), F.lit(None).cast("string").alias("payload_digest"), digest(text(html_col)).alias("raw_digest"), text(html_col).alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: warc_type, record_id, refers_to, target_uri, date, content_type, source_digest, block, block_digest, content_length, record; before them page_id, if there is one.

    `responses` is what `read_warc` or `responses_from_pages` gives; records of other types, or without one, are left out. `record` is the whole
    record but for the blank lines that end it. The source's declared payload digest is kept; without one the digest of its bytes stands in. Null
    fields are empty; an empty payload gives a conversion with an empty block; repeated responses are derived each; an empty table gives no rows.
    """
    own = [c for c in ("page_id",) if c in responses.columns]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = responses.where("warc_type = 'response'").select(*own, one_line(F.col("record_id")).alias("record_id"), one_line(F.col("target_uri")).alias("target_uri"), one_line(F.col("date")).alias("date"), "status", "content_type", "headers", "http_headers", F.coalesce("payload_digest", "raw_digest").alias("source_digest"), text("payload").alias("payload"))
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("payload", _TITLE, 1)), r"\s+", " "))
    links = F.regexp_count("payload", F.lit(_LINK))
    fields = [("source-record-id", F.col("record_id")), ("source-payload-digest", F.col("source_digest")), ("http-status", F.col("status")), ("source-content-type", F.col("content_type")), ("title", title), ("outlinks", links)]
    meta = F.concat(*[x for k, v in fields for x in (F.lit(f"{k}: "), one_line(v), F.lit(CRLF))])
    meta = F.concat(meta, _lines("warc-header-", F.col("headers")), _lines("http-header-", F.col("http_headers")))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("type"), plain_text(F.col("payload")).alias("block")),
    )
    d = r.select(*own, F.col("record_id").alias("refers_to"), "target_uri", "date", one_line(F.col("source_digest")).alias("source_digest"), F.explode(kinds).alias("k"))
    d = d.select(*own, F.col("k.warc_type").alias("warc_type"), record_id(F.col("k.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", F.col("k.type").alias("content_type"), "source_digest", F.col("k.block").alias("block"))
    d = d.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    heads = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    record = F.concat(F.lit("WARC/1.1" + CRLF), *[x for k, c in heads for x in (F.lit(f"{k}: "), F.col(c).cast("string"), F.lit(CRLF))], F.lit(CRLF), F.col("block"))
    return d.withColumn("record", record)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition; the blank lines between records are the writer's line separator."""
    records.select("record").write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Header lines as (name, value), folded lines joined."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records of a WARC file, plain or gzip of any number of members, one at a time.

    Content-Length decides where a block ends, not the blank lines. A record cut short by the end of the file is left out.
    """
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    try:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := f.readline()).strip():
                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            head = _fields(lines)
            size = next((v for k, v in head if k.lower() == "content-length"), "0")
            size = int(size) if size.isdigit() else 0
            block = f.read(size)
            if len(block) == size:
                yield head, block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of a small file: headers by lower-case name, and block."""
    return [({k.lower(): v for k, v in head}, block) for head, block in records(data)]


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body


def _text(body: bytes, kind: str, encoding: str) -> str:
    """A payload as text: its content coding undone, its declared character set (header, else the first kilobyte) or UTF-8."""
    if encoding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47 if encoding != "deflate" else 15).decompress(body)
        except zlib.error:
            pass
    m = re.search(r"charset=[\"']?([\w.:-]+)", kind or "", re.IGNORECASE) or re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", body[:1024], re.IGNORECASE)
    name = m.group(1) if m else "utf-8"
    try:
        codec = codecs.lookup(name if isinstance(name, str) else name.decode("ascii", "replace"))
        return codec.decode(body, "replace")[0] if codec._is_text_encoding else body.decode("utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _row(head: list[tuple[str, str]], block: bytes) -> dict:
    by = {k.lower(): v for k, v in head}
    status, kind, http, encoding = None, by.get("content-type"), [], ""
    if (by.get("warc-type") or "").lower() == "response":
        top, gap, body = block.partition(b"\r\n\r\n")
        first, *rest = top.decode("iso-8859-1").split(CRLF)
        if gap and first.startswith("HTTP/"):
            words, http, block = first.split(), _fields(rest), body
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            own = {k.lower(): v for k, v in http}
            kind, encoding = own.get("content-type"), own.get("content-encoding", "").lower()
            if own.get("transfer-encoding", "").lower() == "chunked":
                block = _unchunked(block)
    return {"warc_type": by.get("warc-type"), "record_id": by.get("warc-record-id"), "refers_to": by.get("warc-refers-to"), "target_uri": by.get("warc-target-uri"), "date": by.get("warc-date"), "status": status, "content_type": kind,
            "headers": [{"name": k, "value": v} for k, v in head], "http_headers": [{"name": k, "value": v} for k, v in http], "payload_digest": by.get("warc-payload-digest"), "raw_digest": "sha256:" + hashlib.sha256(block).hexdigest(), "payload": _text(block, kind, encoding)}


_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_READ = pa.schema([*[(c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "target_uri", "date")], ("status", pa.int32()), ("content_type", pa.string()), ("headers", _FIELDS), ("http_headers", _FIELDS), *[(c, pa.string()) for c in ("payload_digest", "raw_digest", "payload")]])


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of WARC files: warc_type, record_id, refers_to, target_uri, date, status, content_type, headers and http_headers (arrays of name and value, in order), payload_digest (as declared), raw_digest (of the payload's bytes), payload.

    For responses the payload is what follows the HTTP header, its chunks joined, else the block; as text it is decoded from its declared coding and character
    set. A task holds one file's bytes, as compressed, and one batch of records; files split and merge by WARC record.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for head, block in records(content.as_py()):
                    rows.append(_row(head, block))
                    size += len(block)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    schema = f"warc_type string, record_id string, refers_to string, target_uri string, date string, status int, content_type string, headers {_HEADERS}, http_headers {_HEADERS}, payload_digest string, raw_digest string, payload string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op1_warc_derivatives(spark, sf_dir):
    d = derive(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return d.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def _sql_id(*parts: str) -> str:
    h = "md5(" + " || '|' || ".join(parts) + ")"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_decoded(text: str) -> str:
    named = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in sorted(_NAMED.items())) + "}"
    windows = "[" + ", ".join(_quoted(x) for x in _WINDOWS) + "]"
    number = "CASE WHEN lower(c[3]) = 'x' THEN ('0x' || c[4:-2])::INT ELSE c[3:-2]::INT END"
    by_number = f"list_transform([{number}], lambda n: CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n = 160 THEN ' ' WHEN n BETWEEN 128 AND 159 THEN {windows}[n - 127] ELSE chr(n) END)[1]"
    code = f"CASE WHEN c[2] = '#' THEN {by_number} ELSE coalesce({named}[c[2:-2]], c) END"
    return f"list_transform([{text}], lambda t: array_to_string(list_transform(list_zip(string_split_regex(t, {_quoted(_ENTITY)}), list_append(list_transform(regexp_extract_all(t, {_quoted(_ENTITY)}), lambda c: {code}), '')), lambda z: z[1] || z[2]), ''))[1]"


_NL = "chr(13) || chr(10)"
_SQL_TEXT = _sql_decoded(f"regexp_replace(regexp_replace(regexp_replace(payload, {_quoted(_UNSEEN)}, ' ', 'g'), {_quoted(_BREAK)}, chr(10), 'g'), {_quoted(_TAG)}, '', 'g')")
_SQL_TEXT = f"trim(regexp_replace(regexp_replace({_SQL_TEXT}, {_quoted(_SPACES)}, ' ', 'g'), {_quoted(_LINES)}, chr(10), 'g'), ' ' || chr(10))"
_SQL_TITLE = f"trim(regexp_replace({_sql_decoded(f'regexp_extract(payload, {_quoted(_TITLE)}, 1)')}, '\\s+', ' ', 'g'))"
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(page_id::VARCHAR, '') AS pid, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
q AS (SELECT *, translate(url, {_NL}, '  ') AS target_uri, 'sha256:' || sha256(payload) AS source_digest FROM p),
r AS (SELECT *, {_sql_id("'response'", "pid", "url", "source_digest")} AS refers_to FROM q),
k AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS ctype,
         'source-record-id: ' || refers_to || {_NL} || 'source-payload-digest: ' || source_digest || {_NL} || 'http-status: 200' || {_NL}
         || 'source-content-type: text/html; charset=utf-8' || {_NL} || 'title: ' || {_SQL_TITLE} || {_NL}
         || 'outlinks: ' || len(regexp_extract_all(payload, {_quoted(_LINK)})) || {_NL} || 'http-header-Content-Type: text/html; charset=utf-8' || {_NL} AS block FROM r
  UNION ALL SELECT page_id, refers_to, target_uri, source_digest, 'conversion', 'text/plain; charset=utf-8', {_SQL_TEXT} FROM r),
d AS (SELECT *, {_sql_id("warc_type", "refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest, octet_length(encode(block))::BIGINT AS content_length FROM k)
SELECT page_id, warc_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length,
       sha256('WARC/1.1' || {_NL} || 'WARC-Type: ' || warc_type || {_NL} || 'WARC-Record-ID: ' || record_id || {_NL} || 'WARC-Refers-To: ' || refers_to || {_NL}
       || 'WARC-Target-URI: ' || target_uri || {_NL} || 'WARC-Date: 2024-01-01T00:00:00Z' || {_NL} || 'WARC-Block-Digest: ' || block_digest || {_NL}
       || 'WARC-Source-Payload-Digest: ' || source_digest || {_NL} || 'Content-Type: ' || ctype || {_NL} || 'Content-Length: ' || content_length || {_NL} || {_NL} || block) AS record_sha256
FROM d
"""
