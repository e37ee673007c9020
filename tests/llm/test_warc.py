"""WARC derivatives: links, digests, text, the file format's round trip."""

import gzip
import hashlib
import html as html_names

import pytest
from llm_fixtures import SF_SMALL

from tidewatch.llm import warc

RESPONSES = warc.RESPONSE


def derived(spark, rows):
    return {(r["refers_to"], r["warc_type"]): r for r in
            warc.derivatives(spark.createDataFrame(rows, RESPONSES)).collect()}


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_records_are_linked_and_digested(spark):
    html = ('<html lang="fr"><head><title>Un\n titre</title></head><body><p>A &amp; b<br>c</p>'
            '<a href="/x">d</a><script>no()</script></body></html>')
    got = derived(spark, [("<urn:uuid:1>", "http://a/", "2024-05-05T00:00:00Z", "text/html", html)])
    meta, text = got["<urn:uuid:1>", "metadata"], got["<urn:uuid:1>", "conversion"]
    assert text["block"] == "A & b\nc\nd"
    assert meta["block"].split("\r\n")[:3] == ["title: Un titre", "language: fr", "outlinks: 1"]
    assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    for r in (meta, text):
        assert (r["refers_to_uri"], r["refers_to_date"]) == ("http://a/", "2024-05-05T00:00:00Z")
        assert r["source_content_type"] == "text/html" and r["source_digest"] == sha(html)
        assert r["block_digest"] == sha(r["block"])
        assert r["content_length"] == len(r["block"].encode())
        assert r["record_id"].startswith("<urn:uuid:") and len(r["record_id"]) == 47


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a</p><p>b</p>", "a\nb"), ("<!-- <p>x</p> -->y", "y"),
    ("a<b>c</b>d", "acd"), ("&lt;p&gt; &amp;lt;", "<p> &lt;"), ("<style>x</style >z", "z"),
    ("<ul><li>1</li>\n<li>2</li></ul>", "1\n2"), ("a   \n\t b", "a b"), ("x < y", "x < y"),
    ("<script>1</script>a<script>2</script>", "a"), ("é&nbsp;ü", "é ü"), ("<SCRIPT>q</Script>k", "k"),
    ("<p>" + "w " * 50_000, ("w " * 50_000).strip())])
def test_plain_text(spark, html, text):
    row = derived(spark, [("<u>", None, None, None, html)])["<u>", "conversion"]
    assert row["block"] == text
    assert row["source_digest"] == sha(html or "")


def test_written_records_read_back(spark, tmp_path):
    rows = [("<urn:uuid:1>", "http://a/", "2024-05-05T00:00:00Z", "text/html", "<p>é\r\n\r\nWARC/1.1"),
            ("<urn:uuid:2>", "http://b/\r\nX: y", None, None, None)]
    made = warc.warc_bytes(warc.derivatives(spark.createDataFrame(rows, RESPONSES))).collect()
    data = b"".join(bytes(r["record"]) for r in made)
    for packed in (data, gzip.compress(data[:900]) + gzip.compress(data[900:])):
        back = list(warc.parse_records(packed))
        assert len(back) == 4
        for r, (h, block) in zip(made, back):
            assert block.decode() == r["block"]
            assert h["warc-record-id"] == r["record_id"] and h["warc-refers-to"] == r["refers_to"]
            assert h["warc-type"] == r["warc_type"] and "x" not in h
            assert h["warc-block-digest"] == r["block_digest"]


def test_reads_response_records(spark, tmp_path):
    def record(kind, rid, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n"
                f"WARC-Target-URI: http://{rid}/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
                f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
                ).encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX: y\r\n\r\n<p>hi</p>"
    data = record("warcinfo", "i", b"x") + record("response", "a", http) + \
        record("request", "a", b"GET /") + record("response", "b", b"raw") + b"junk"
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted(tuple(r) for r in warc.read_warc(spark, str(tmp_path)).collect())
    one = [("a", "http://a/", "2024-01-01T00:00:00Z", "text/html", "<p>hi</p>"),
           ("b", "http://b/", "2024-01-01T00:00:00Z", "application/http", "raw")]
    assert got == sorted(one * 2)
    assert warc.derivatives(warc.read_warc(spark, str(tmp_path))).count() == 8


def test_broken_files_end_quietly():
    assert list(warc.parse_records(b"")) == []
    assert list(warc.parse_records(b"WARC/1.0\r\nno length\r\n\r\nx")) == []
    assert list(warc.parse_records(b"WARC/1.0\r\nContent-Length: 3")) == []


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([("<u>", "http://a", None, None, "x")] * 2, RESPONSES) \
        .selectExpr("*", "'k' AS block", "1 AS warc_type", "'b' AS block_", "2 AS refers_to",
                    "3 AS source_digest", "4 AS __n", "5 AS __r", "6 AS n", "7 AS text", "8 AS m")
    made = warc.derivatives(rows)
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    got = made.collect()
    assert len(got) == 4 and len({r["record_id"] for r in got}) == 2
    assert {(r["block__"], r["block_"], r["warc_type_"], r["refers_to_"], r["source_digest_"], r["__n"], r["__r"],
             r["n"], r["text"], r["m"]) for r in got} == {("k", "b", 1, 2, 3, 4, 5, 6, 7, 8)}
    assert {r["refers_to"] for r in got} == {"<u>"}
    assert warc.derivatives(rows.limit(0)).collect() == []


def test_oracle_decodes_as_the_standard_library(spark):
    import duckdb
    refs = [f"&{name}" for name in html_names.entities.html5]
    refs += [f"&#{k};" for k in (0, 1, 13, 38, 128, 159, 160, 233, 8217, 55296, 64976, 65533, 1114111, 1114112)]
    refs += ["&#x27;", "&#X1F600", "&#x;", "&copyx;", "&notit;", "&nosuch;", "&", "&&amp;", "&#99999999999999999999;"]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE p AS SELECT {warc._PATTERN} AS pattern, {warc._NAMES} AS names")
    con.execute("CREATE TABLE t (k INTEGER, bare VARCHAR)")
    texts = [f"a{r}b {r}" for r in refs]
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = [x for _, x in sorted(con.execute(f"SELECT k, {warc._sql_decoded('bare')} FROM t, p").fetchall())]
    assert got == [warc.unescaped(t) for t in texts]


def test_query_has_two_records_a_page(spark):
    rows = warc.query(spark, SF_SMALL).collect()
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    assert len(rows) == 2 * pages == len({r["record_id"] for r in rows})


def test_every_reference_is_decoded(spark):
    """Against the standard library: all names, decimal and hex, in text and title."""
    refs = [f"&{name}" for name in html_names.entities.html5 if name.endswith(";")]
    refs += ["&#8217;", "&#x27;", "&#X1F600;", "&#233;", "&copy", "&#128;", "&nosuch;", "&amp;eacute;",
             "&#38;amp;", "&#1;", "&#xD800;", "&amp;#60;"]
    raw = "x".join(f"[{r}]" for r in refs)
    want = " ".join(html_names.unescape(raw).replace("\xa0", " ").replace("\n", " ").replace("\t", " ").split(" "))
    got = derived(spark, [("<u>", None, None, None, f"<title>Caf&eacute; &#8217;n&nbsp;&#x27;</title><p>{raw}</p>"),
                          ("<v>", None, None, None, "\xa0a&copy;&nbsp;&#160;b&#xa0;c")])
    assert got["<u>", "conversion"]["block"].split("\n")[-1] == want
    assert got["<u>", "metadata"]["block"].startswith("title: Caf\u00e9 \u2019n '\r\n")
    assert got["<v>", "conversion"]["block"] == "\xa0a\u00a9 b c"
