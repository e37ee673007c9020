"""WARC derivatives: linked metadata and plain-text conversion records (operator 4).

Every ``response`` record yields a ``metadata`` record about it (title, language,
links, counts, as ``application/warc-fields``) and a ``conversion`` record with
its plain text. Both carry ``WARC-Refers-To`` with the response's record id, its
target URI and its date; both repeat the source's headers that identify it
(content type, payload digest) and bear digests of their own blocks. Record ids
derive from the response's id and the record type, so a rerun gives the same
records.

All of it is column expressions over one narrow scan; only character references
are decoded by an Arrow UDF, as HTML5 does (``html.unescape``). ``warc_bytes`` writes the
records out in the WARC/1.1 format; ``scan_warc`` (see ``warc_files``) reads files of
that format as responses, with their own digests and headers, and faults.
"""

from __future__ import annotations

import html as html_names
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, fresh, table
from .warc_files import RESPONSE, parse_records, read_warc  # noqa: F401

VERSION = "WARC/1.1"


def digest(block: Column) -> Column:
    """A labelled digest of a text's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based urn:uuid (version 8, from SHA-256 of the parts)."""
    h = F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4),
                    F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3),
                    F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


# HTML to text: (pattern, replacement), applied in order; the patterns mean the same
# in Java's and RE2's syntax. Elements that hold no text and comments go first, ends
# of blocks become marks, other tags nothing; white space is then one space and a run
# of marks a line end.
MARK = "\x01"
_NO_TEXT = "|".join(rf"{t}\b[^>]*>.*?</{t}\s*>"
                    for t in ("script", "style", "noscript", "template", "head"))
TEXT_STEPS = (
    (rf"(?is)<(?:!--.*?-->|{_NO_TEXT})", " "),
    (r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|title)"
     r"\b|[bh]r\b)[^>]*>", MARK),
    (r"<[^>]*>", ""),
    (r"[\t\r\n\f]+", " "),
    (r"  +", " "),
    (rf" ?{MARK}[ {MARK}]*", "\n"),
)
TAG_STEPS = 3             # of TEXT_STEPS, before references are decoded
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _character(m: re.Match) -> str:
    char = html_names.unescape(m[0])
    # a reference to a no-break space is a space; the character itself stays
    return char if "\xa0" in m[0] else char.replace("\xa0", " ")


def unescaped(text: str) -> str:
    """``html.unescape``, with a space for a no-break space's reference."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(unescaped, na_action="ignore")


def plain_text(html: Column) -> Column:
    """The text of an HTML payload; null and empty give an empty text. References are
    decoded once all tags are gone, and before white space is one space."""
    text = F.coalesce(html, F.lit(""))
    for k, (pattern, put) in enumerate(TEXT_STEPS):
        if k == TAG_STEPS:
            text = _unescaped(text)
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return F.btrim(text, F.lit(" \n"))


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of crawled pages, with the page id first."""
    key = F.concat_ws("|", F.lit("page"), F.col(id_col).cast("string"),
                      F.col(url_col))
    return pages.select(F.col(id_col).alias("page_id"),
                        record_id(key, F.lit("response")).alias("record_id"),
                        F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"),
                        F.lit("text/html; charset=utf-8").alias("content_type"),
                        F.col(html_col).alias("payload"))


ADDED = {"warc_type", "record_id", "refers_to", "refers_to_uri", "refers_to_date", "concurrent_to",
         "content_type", "source_content_type", "source_digest", "block", "block_digest",
         "content_length"}


def _fields(name: str, headers: Column) -> Column:
    """A ``name-header`` field of each header line, which says its name and value."""
    lines = F.btrim(headers.cast("string"), F.lit("\r\n"))
    return F.when(F.coalesce(lines, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(f"{name}-header: "),
                 F.regexp_replace(F.regexp_replace(lines, r"\r?\n[ \t]+", " "), r"[\r\n]+",
                                  f"\r\n{name}-header: "), F.lit("\r\n")))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: its ``metadata`` and its ``conversion`` record.

    Other columns of ``responses`` are carried along; one whose name is also that of a
    column added gets ``_`` behind it. Columns added: warc_type, record_id (the response's becomes refers_to), refers_to,
    refers_to_uri, refers_to_date, concurrent_to (the record made with it),
    content_type, source_content_type, source_digest, block, block_digest,
    content_length. A null payload is an empty one (its conversion is empty, its
    digest that of no bytes); null URIs and dates stay null. Repeated rows give
    repeated records with equal ids. An empty table gives none.

    Where ``responses`` has them (``scan_warc``), ``payload_digest`` is the source's
    digest (null: that of the payload's text), and each line of ``warc_headers`` and
    ``http_headers`` is a ``warc-header`` or ``http-header`` field of the metadata."""
    document_batches(responses.sparkSession)
    used = {"record_id", "target_uri", "warc_date", "content_type", "payload",
            "payload_digest", "warc_headers", "http_headers"}
    carried = [c for c in responses.columns if c.lower() not in used]
    out = [c for c in carried if c.lower() not in ADDED]
    for c in carried:
        if c.lower() in ADDED:
            taken = {x.lower() for x in (*carried, *out)} | ADDED
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            responses = responses.withColumnRenamed(c, new)
            out.append(new)
    carried = out
    has = {x.lower() for x in responses.columns}
    n, title_, lang_, links_, text_, m, c, r, from_, uri, date, kind, digest_, heads = fresh(
        responses, "n", "title", "lang", "links", "text", "m", "c", "r", "from", "uri", "date", "kind", "digest",
        "heads")
    html = F.coalesce("payload", F.lit(""))
    source = digest(html)
    if "payload_digest" in has:
        source = F.coalesce(F.col("payload_digest").cast("string"), source)
    lines = [_fields(name, F.col(f"{name}_headers")) for name in ("warc", "http") if f"{name}_headers" in has]
    text = plain_text(F.col("payload"))
    title = F.regexp_replace(_unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)),
                             r"\s+", " ")
    lang = F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*\bhref="))
    made = responses.select(
        *[F.col(f"`{x}`") for x in carried], F.col("record_id").alias(from_),
        F.col("target_uri").alias(uri), F.col("warc_date").alias(date),
        F.col("content_type").alias(kind), source.alias(digest_),
        F.concat(F.lit(""), *lines).alias(heads),
        F.octet_length(html).alias(n), title.alias(title_), lang.alias(lang_),
        links.alias(links_), text.alias(text_),
        record_id(F.col("record_id"), F.lit("metadata")).alias(m),
        record_id(F.col("record_id"), F.lit("conversion")).alias(c))
    fields = F.concat(
        F.lit("title: "), title_, F.lit("\r\nlanguage: "), lang_, F.lit("\r\noutlinks: "),
        F.col(links_).cast("string"), F.lit("\r\nsource-length: "), F.col(n).cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length(text_).cast("string"), F.lit("\r\n"), F.col(heads))
    both = made.select("*", F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col(m).alias("record_id"),
                 F.col(c).alias("concurrent_to"),
                 F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col(c).alias("record_id"),
                 F.col(m).alias("concurrent_to"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"),
                 F.col(text_).alias("block")))).alias(r))
    return both.select(
        *[F.col(f"`{x}`") for x in carried], f"{r}.warc_type", f"{r}.record_id",
        F.col(from_).alias("refers_to"), F.col(uri).alias("refers_to_uri"),
        F.col(date).alias("refers_to_date"), f"{r}.concurrent_to", f"{r}.content_type",
        F.col(kind).alias("source_content_type"), F.col(digest_).alias("source_digest"), f"{r}.block",
        digest(F.col(f"{r}.block")).alias("block_digest"),
        F.octet_length(f"{r}.block").alias("content_length"))


def _header(name: str, value: Column) -> Column:
    # a line end inside a value would start another header
    return F.when(value.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "),
                 F.lit("\r\n")))


def warc_bytes(records: DataFrame) -> DataFrame:
    """``records`` of ``derivatives`` with the WARC record as bytes in ``record``."""
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", F.col("warc_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.col("refers_to_date")),
        _header("WARC-Target-URI", F.col("refers_to_uri")),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _header("WARC-Refers-To-Date", F.col("refers_to_date")),
        _header("WARC-Concurrent-To", F.col("concurrent_to")),
        _header("WARC-Source-Content-Type", F.col("source_content_type")),
        _header("WARC-Source-Payload-Digest", F.col("source_digest")),
        _header("WARC-Block-Digest", F.col("block_digest")),
        _header("Content-Type", F.col("content_type")),
        _header("Content-Length", F.col("content_length")), F.lit("\r\n"))
    return records.withColumn("record", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


def query(spark, sf_dir):
    made = derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "refers_to_uri",
                       "refers_to_date", "concurrent_to", "content_type", "source_content_type",
                       "source_digest", "block_digest", F.col("content_length").cast("long")
                       .alias("content_length"))


def _sql_string(text: str) -> str:
    text = text.replace("'", "''")
    for c in ("\n", MARK):
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{text}')"


def _sql_steps(html: str, steps) -> str:
    for pattern, put in steps:
        html = f"regexp_replace({html}, {_sql_string(pattern)}, {_sql_string(put)}, 'g')"
    return html


def _sql_references() -> tuple[str, str]:
    """DuckDB SQL of (a pattern of the references that HTML5 decodes, the map from a named
    one to its character), from the standard library's table. Whole names come first, then
    those that need no semicolon, the longest first."""
    whole = sorted(k for k in html_names.entities.html5 if k.endswith(";"))
    bare = sorted((k for k in html_names.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    pattern = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|" + "|".join(whole + bare) + ")"
    keys = ", ".join(_sql_string("&" + k) for k in whole + bare)
    chars = ", ".join("(" + " || ".join(f"chr({ord(c)})" for c in html_names.entities.html5[k]) + ")"
                      for k in whole + bare)
    return _sql_string(pattern), f"map([{keys}], [{chars}])"


def _sql_decoded(text: str) -> str:
    """The text with every reference decoded; ``p`` is the table of pattern and names."""
    code = ("coalesce(try_cast(CASE WHEN lower(r[3:3]) = 'x' THEN '0x' || rtrim(r[4:], ';') "
            "ELSE rtrim(r[3:], ';') END AS BIGINT), 1114112)")
    odd = "".join(f" WHEN {k} THEN chr({ord(v)})" for k, v in sorted(html_names._invalid_charrefs.items())
                  if k and v != chr(k))
    none = ", ".join(str(k) for k in sorted(html_names._invalid_codepoints))
    number = (f"CASE {code}{odd} WHEN 0 THEN chr(65533) ELSE CASE WHEN {code} BETWEEN 55296 AND 57343 "
              f"OR {code} > 1114111 THEN chr(65533) WHEN {code} IN ({none}) AND {code} <> 13 THEN '' "
              f"ELSE chr(CAST({code} AS INTEGER)) END END")
    char = f"CASE WHEN r[2:2] = '#' THEN {number} ELSE names[r] END"
    decoded = f"list_transform(regexp_extract_all({text}, pattern), lambda r: replace({char}, chr(160), ' '))"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, pattern), {decoded}), "
            "lambda z: z[1] || coalesce(z[2], '')), '')")


def _sql_id(key: str, kind: str) -> str:
    h = f"sha256({key} || chr(10) || '{kind}')"
    return (f"('<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-a' || "
            f"{h}[18:20] || '-' || {h}[21:32] || '>')")


_PATTERN, _NAMES = _sql_references()
ORACLE = {"op4_warc_derivatives": f"""
WITH p AS (SELECT {_PATTERN} AS pattern, {_NAMES} AS names),
r AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         {_sql_id("concat_ws('|', 'page', CAST(page_id AS VARCHAR), url)", "response")} AS id
  FROM pages),
g AS (
  SELECT *, {_sql_steps("html", TEXT_STEPS[:TAG_STEPS])} AS bare,
         regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS heading
  FROM r),
t AS (
  SELECT *, trim({_sql_steps(_sql_decoded("bare"), TEXT_STEPS[TAG_STEPS:])}, ' ' || chr(10)) AS txt, {_sql_id("id", "metadata")} AS m,
         {_sql_id("id", "conversion")} AS c,
         regexp_replace({_sql_decoded("heading")}, '\\s+', ' ', 'g') AS title,
         regexp_extract(html, '(?i)<html[^>]*\\blang=["'']?([A-Za-z-]+)', 1) AS lang,
         len(regexp_extract_all(html, '(?i)<a\\s[^>]*\\bhref=')) AS links
  FROM g, p),
b AS (
  SELECT page_id, 'conversion' AS warc_type, c AS record_id, id AS refers_to, url, m AS concurrent_to,
         'text/plain; charset=utf-8' AS content_type, html, txt AS block FROM t
  UNION ALL
  SELECT page_id, 'metadata', m, id, url, c, 'application/warc-fields', html,
         'title: ' || title || chr(13) || chr(10) || 'language: ' || lang || chr(13) || chr(10) ||
         'outlinks: ' || links || chr(13) || chr(10) || 'source-length: ' || strlen(html) ||
         chr(13) || chr(10) || 'text-length: ' || strlen(txt) || chr(13) || chr(10) FROM t)
SELECT page_id, warc_type, record_id, refers_to, url AS refers_to_uri,
       '2024-01-01T00:00:00Z' AS refers_to_date, concurrent_to, content_type,
       'text/html; charset=utf-8' AS source_content_type, 'sha256:' || sha256(html) AS source_digest,
       'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length
FROM b"""}

QUERIES = {"op4_warc_derivatives": query}
