import base64
import hashlib
import re

from helpers import sf

from flipframe.llm import warc_derivatives as W

SCHEMA = "page_id long, warc_type string, record_id string, target_uri string, warc_date string, headers string, block binary, refers_to string"


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_pages_against_brute_force(spark):
    pages = sf(spark, "pages")
    html = {r.page_id: r for r in pages.collect()}
    made = W.derivatives(W.page_responses(pages)).collect()
    assert len(made) == 2 * len(html)
    ids = {r.record_id for r in W.page_responses(pages).collect()}
    assert len({r.record_id for r in made}) == len(made) and {r.refers_to for r in made} == ids
    for r in made:
        page = html[r.page_id]
        raw = r.block.encode()
        assert r.source_digest == sha1(page.html.encode()) and r.block_digest == sha1(raw) and r.content_length == len(raw)
        assert r.target_uri == page.url and f"Content-Length: {len(page.html.encode())}" in r.source_headers.split("\r\n")
        if r.warc_type == "metadata":
            links = [x[9:] for x in r.block.split("\r\n") if x.startswith("outlink: ")]
            assert links == re.findall(r'<a href="([^"]*)"', page.html)
        else:
            body = re.sub(r"<head>.*?</head>|<!--.*?-->", "", page.html, flags=re.S)
            import html as H

            assert "".join(r.block.split()) == "".join(H.unescape(re.sub(r"<[^>]*>", "", body)).split())


def response(k, block, kind="response", ident="<urn:uuid:{}>", uri="http://u/", date="2024-05-06T07:08:09Z", headers="X-Own: 1"):
    return (k, kind, ident and ident.format(k), uri, date, headers, block, "clash")


def test_awkward_responses(spark):
    gone = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nServer: s\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n3\r\na\xe9b\r\n2\r\ncd\r\n0\r\n\r\n"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    rows = [
        response(1, gone), response(2, chunked), response(3, image), response(4, None), response(5, b""), response(6, b"no http"),
        response(7, gone, kind="request"), response(8, gone, ident=None), response(9, gone, uri=None, date=None, headers=None), response(1, gone),
        response(10, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such\r\n\r\n<p>x &amp; y" + b" z" * 50_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in W.derivatives(df).collect():
        got.setdefault((r.page_id, r.warc_type), []).append(r)
    assert sorted(got) == [(1, "metadata"), (2, "conversion"), (2, "metadata"), (3, "metadata"), (4, "metadata"), (5, "metadata"), (6, "metadata"), (9, "metadata"), (10, "conversion"), (10, "metadata")]
    assert len(got[1, "metadata"]) == 2 and len({r.record_id for r in got[1, "metadata"]}) == 1
    assert got[2, "conversion"][0].block == "aébcd" and got[2, "conversion"][0].source_digest == sha1(b"a\xe9bcd")
    assert got[1, "metadata"][0].source_headers == "X-Own: 1\r\nContent-Type: text/html\r\nServer: s" and got[1, "metadata"][0].warc_date == "2024-05-06T07:08:09Z"
    assert got[10, "conversion"][0].block.startswith("x & y z")
    assert W.derivatives(df.limit(0)).count() == 0


def test_record_bytes_are_well_formed(spark):
    made = W.record_bytes(W.derivatives(W.page_responses(sf(spark, "pages").limit(5))), "record").collect()
    for r in made:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n" and sha1(rest[:n]) == fields["WARC-Block-Digest"]
        assert fields["WARC-Refers-To"] == r.refers_to


def test_null_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    got = W.derivatives(W.page_responses(df)).collect()
    assert [r.warc_type for r in got] == ["metadata"] * 2


def test_metadata_bytes_hold_every_source_header(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: s/1 (x: y)\r\nLast-Modified: Mon\r\nX: a\nb\r\nServer: two\r\n\r\n<a href='u'>t</a>"
    rows = [response(1, block, headers="X-Own: 1\r\nX-Two: 2"), response(2, None, headers=None)]
    made = {(r.page_id, r.warc_type): bytes(r.record) for r in W.record_bytes(W.derivatives(spark.createDataFrame(rows, SCHEMA))).collect()}
    head, _, rest = made[1, "metadata"].partition(b"\r\n\r\n")
    lines = rest.decode().split("\r\n")
    assert [x[15:] for x in lines if x.startswith("source-header: ")] == [
        "X-Own: 1", "X-Two: 2", "Content-Type: text/html", "Server: s/1 (x: y)", "Last-Modified: Mon", "X: a", "Server: two",
    ]
    assert lines[lines.index("source-header: X: a") + 1] == " b" and "outlink: u" in lines
    assert f"Content-Length: {len(rest) - 4}".encode() in head.split(b"\r\n")
    assert b"source-header" not in made[2, "metadata"] and b"source-header" not in made[1, "conversion"]


def test_broken_chunks_end():
    assert W._dechunked(b"-6\r\nabc") == b"-6\r\nabc"
    assert W._dechunked(b"3;x=1\r\nabc\r\n0x2\r\nde\r\n") == b"abc"
    assert W._dechunked(b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"


def test_page_facts_are_linear_and_skip_comments():
    import time

    t = time.perf_counter()
    for page in ("<a " * 80_000, "<title>" * 40_000, '<a x="' * 50_000, "<!--" * 50_000, "<a href='" * 50_000):
        W.page_facts(page)
    assert time.perf_counter() - t < 5
    page = "<html lang=EN-us><!-- <a href=/no> --><title>A &amp; B</title><a class=\"x>y\" href='/p?a=1&amp;b=2'>t</a><A HREF=/q>u</A><a data-href=/n>v</a><script>'<a href=/s>'</script>"
    assert W.page_facts(page) == ("A & B", "en-us", ["/p?a=1&b=2", "/q"])


def test_text_ids_and_line_ends_in_urls(spark):
    df = spark.createDataFrame([("p-1", "http://a/\r\nX-Evil: 1", "<p>x</p>"), (None, None, None)], "page_id string, url string, html string")
    rows = W.record_bytes(W.derivatives(W.page_responses(df))).collect()
    assert {r.page_id for r in rows} == {"p-1", None}
    for r in rows:
        head = bytes(r.record).split(b"\r\n\r\n")[0]
        assert b"X-Evil" not in b"".join(x for x in head.split(b"\r\n") if x.startswith(b"X-")) and b"%0D%0AX-Evil" in head or r.page_id is None
