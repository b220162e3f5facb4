"""HTML main text with a suffix array over each host's token streams.

A page's blocks (text between block-level tags) carry their markup's zone: article, marked
boilerplate (menus, headers, footers, asides, forms, adverts, notices, comments by element, role
or class) or plain.  The blocks outside articles of all pages of a host form its token stream.
Every position starts a suffix that ends with its block; suffixes whose first ``RUN`` words are
equal stand next to each other in the host's suffix array with a common prefix of at least ``RUN``
words.  Where such a group comes from ``SHARE`` of the host's distinct pages, and from two at least,
its words are a repeated run; the union of these windows is exactly the set of all repeats of
``RUN`` words or more on as many pages, so the array need not be sorted any deeper.  A block of
fewer words is repeated as a whole or not at all, and from ``SHORT_PAGES`` pages on.  Covered words
go; of what is left, unique plain runs stay, marked boilerplate goes.  Article blocks stay even
where they repeat: a mirrored or quoted article is no template.

Pages of a host with equal words outside marked blocks are copies of one page and count once, so
an article that is stored or mirrored under many ids and urls is no repeat.

The groups are found by an aggregate over (host, prefix) words with map-side partial results, so
a host with a third of all pages needs no task of its own.

Null, empty and text-less pages give an empty text.  Entities are decoded; white space inside a
block becomes one space; blocks are joined by two newlines in page order.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import free_name, ready, scan_texts, written
from flipframe.llm.url_automaton import host_and_path

RUN = 6  # words of the shortest repeated run inside a block
SHARE = 0.3  # of a host's distinct pages that a repeated run is on
SHORT_PAGES = 3  # distinct pages, at least, that a repeated block of under RUN words is on
SALTS = 64  # rows of a host in the join of its page count

ARTICLE, MARKED, PLAIN = 0, 1, 2

#: Elements whose content is never text of the page.
_RAW = frozenset("script style noscript template svg math iframe object canvas head title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKED = frozenset("nav footer aside form menu button select textarea dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead footer sidebar widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended trending comment comments commentlist disqus replies respond copyright "
    "disclaimer pagination pager toolbar".split()
)
_CONTENT = frozenset("content article main post entry story body text".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Containers whose <article> elements are teasers.
_TEASERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar widget related recommended trending".split())
#: A class with one of these at its begin or end tells the state or layout of a wrapper, not what it holds.
_BEFORE = frozenset("has no not without with is hide show js".split())
_AFTER = frozenset("open opened closed fixed active visible enabled disabled collapsed expanded on off layout page template".split())

#: What an element lets inside it be an article: anything, a <main> only, nothing.
ANY, MAIN, NONE = 0, 1, 2

#: A quote opens a value only after "="; elsewhere it is a plain character.  Possessive, so a tag without an end fails at once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>", re.S
)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)", re.I)
#: Blocks of running text: an inline element inside one belongs to its sentence, whatever its class.
_TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 td th dd dt blockquote figcaption pre caption".split())
_CLOSES_P = _BLOCK - frozenset(["html", "body"])
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in _RAW}


def _names(value: str) -> tuple[set[str], set[str], bool]:
    """All words of a class or id value; the first and last words of its names that mark what an
    element holds: whole names or compounds such as cookie-notice, but no layout or state classes
    such as has-sidebar or menu-open; and whether a name says content by its last word, which rules a
    compound (main-nav is a menu, sidebar-content is not)."""
    words, ends, content = set(), set(), False
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        words.update(parts)
        content |= bool(parts) and parts[-1] in _CONTENT
        if parts and parts[0] not in _BEFORE and (len(parts) == 1 or parts[-1] not in _AFTER) and not {"with", "has", "no", "without"} & set(parts):
            ends |= {parts[0], parts[-1]}
    return words, ends, content


def _zone_of(name: str, attrs: str, in_article: bool) -> tuple[int | None, int]:
    """The zone that an element opens, or None if it has none of its own, and what may be an
    article inside it."""
    words, ends, role, hidden, content = set(), set(), "", False, False
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                got = _names(value)
                words |= got[0]
                ends |= got[1]
                content |= got[2]
            elif key == "role":
                role = value
            else:
                hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", "")
    if name not in ("html", "body") and ends & _COMMENTS or hidden:
        return MARKED, NONE
    if name in ("article", "main") or role in ("main", "article"):
        return ARTICLE, ANY
    if name in ("html", "body"):
        return None, ANY
    if name in ("aside", "footer") or role in ("complementary", "contentinfo"):
        return MARKED, NONE
    if name in _MARKED or role in _ROLES or ends & _CLASSES and not content:
        return MARKED, MAIN if ends & _TEASERS else ANY
    if not in_article and (name == "header" or "header" in ends and not words & _CONTENT):
        return MARKED, ANY
    return None, ANY


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page, in order, white space normalised."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # open elements, the zone inside and what may be an article there
    where: dict[str, list[int]] = {}  # places of each name's open elements
    open_blocks: list[int] = []  # places of the open blocks
    endless: set[str] = set()
    buf: list[str] = []
    zone, at, n = PLAIN, 0, len(page)

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((zone, text))

    def close(k: int) -> None:
        """Close the elements from place ``k`` on; each is closed once, so all closing is linear."""
        while len(stack) > k:
            where[stack.pop()[0]].pop()
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buf.append(page[at:])
            break
        if lt > at:
            buf.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            buf.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name in _BLOCK:
                flush()
            # a stray inline end tag closes no block
            if where.get(name) and (name in _BLOCK or not open_blocks or open_blocks[-1] < where[name][-1]):
                k = where[name][-1]
                if stack[k][1] != (stack[k - 1][1] if k else PLAIN):
                    flush()
                close(k)
                zone = stack[-1][1] if stack else PLAIN
            continue
        if name in _RAW and not m.group(3).endswith("/") and name not in endless:
            if name == "head":
                body = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at = n if body is None else body.end() if body.group().startswith("</") else body.start()
                continue
            end = _RAW_END[name].search(page, at)
            if end is None and name == "title":
                endless.add(name)  # no later one ends either: plain markup
            else:
                at = end.end() if end else n
                continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P and where.get("p") and open_blocks[-1] == where["p"][-1]:
                close(where["p"][-1])
            if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            zone = stack[-1][1] if stack else PLAIN
        elif name == "br":
            buf.append(" ")
        if name in _VOID or m.group(3).endswith("/"):
            continue
        opened, lets = _zone_of(name, m.group(3), zone == ARTICLE)
        if name not in _BLOCK and open_blocks and stack[open_blocks[-1]][0] in _TEXTUAL:
            opened, lets = None, ANY  # no inline element splits a block
        shut = stack[-1][2] if stack else ANY
        inside = zone
        if opened == MARKED:
            inside = MARKED
        elif opened == ARTICLE and (shut == ANY or shut == MAIN and name == "main"):
            inside = ARTICLE
            shut = ANY
        if inside != zone:
            flush()
        where.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            open_blocks.append(len(stack))
        stack.append((name, inside, max(shut, lets)))
        zone = inside
    flush()
    return out


def main_text(found: list[tuple[int, str]], starts: set[int], run: int = RUN) -> str:
    """Article blocks, and the unique runs of plain blocks.

    ``starts`` holds the positions, in the stream of words outside articles, where repeated runs
    of ``run`` words or to the end of a shorter block begin.
    """
    out, at = [], 0
    for zone, text in found:
        if zone == ARTICLE:
            out.append(text)
            continue
        words = text.split(" ")
        if zone == PLAIN:
            covered = {k + n for k in range(len(words)) if at + k in starts for n in range(run)}
            left: list[str] = []
            for k, w in enumerate([*words, None]):
                if w is not None and k not in covered:
                    left.append(w)
                    continue
                if left:
                    out.append(" ".join(left))
                left = []
        at += len(words)
    return "\n\n".join(out)


def _signed(data: bytes) -> int:
    import xxhash

    k = xxhash.xxh64_intdigest(data)
    return k - (1 << 64) if k >> 63 else k


def suffix_keys(found: list[tuple[int, str]], run: int) -> list[tuple[str, int, bool]]:
    """(key, place, short) of every suffix of the stream outside articles that is ``run`` words or
    a whole shorter block long; the key is its first ``run`` words.  No suffix reaches into the
    next block."""
    out, at = [], 0
    for zone, text in found:
        if zone == ARTICLE:
            continue
        words = text.split(" ")
        if len(words) < run:
            out.append((text, at, True))
        else:
            out += [(" ".join(words[i : i + run]), at + i, False) for i in range(len(words) - run + 1)]
        at += len(words)
    return out


def copy_key(host: bytes, found: list[tuple[int, str]]) -> int:
    """Hash of host and the words outside marked blocks, or of all words if there are none."""
    kept = [t for z, t in found if z != MARKED] or [t for _, t in found]
    return _signed(host + b"\0" + " ".join(kept).encode())


def _parsed(raw: bytes | None) -> list[tuple[int, str]]:
    return blocks(raw.decode("utf-8", "replace")) if raw else []


def _suffix_rows(run: int):
    """Rows of all suffixes, and one row without a key for each page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SUFFIX.fields]
            for ident, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                found = blocks(html or "")
                name = host_and_path((url or "").encode())[0]
                got = [(None, -1, False), *suffix_keys(found, run)]
                fixed = (name, copy_key(name, found), ident, any(z == PLAIN for z, _ in found))
                for column, value in zip(out, fixed):
                    column += [value] * len(got)
                for column, values in zip(out[len(fixed) :], zip(*got)):
                    column += values
                if len(out[0]) > 1 << 17:
                    yield _batch(out)
                    out = [[] for _ in _SUFFIX.fields]
            yield _batch(out)

    return rows


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_SUFFIX.names)


_SUFFIX = T.StructType(
    [T.StructField("host", T.BinaryType()), T.StructField("copy", T.LongType()), T.StructField("ident", T.LongType()), T.StructField("plain", T.BooleanType())]
    + [T.StructField("key", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("short", T.BooleanType())]
)
_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("open", T.BooleanType())])


def page_texts(pages: DataFrame, run: int = RUN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A page whose blocks are all article or marked is finished by the first pass, as no repeated
    run can change its text; only pages with plain blocks meet the starts of their repeated runs.
    """
    ready(pages.sparkSession)
    src = pages.select(id_col, url_col, F.col(f"`{html_col}`").cast("string").alias("html"))
    if id_col == "html" or url_col == "html":
        raise ValueError("the id and url columns can't be named html")
    ident = F.xxhash64(F.col(id_col).cast("string"), url_col, "html")

    def first_pass():
        def scan(raws):
            found = [_parsed(r) for r in raws]
            undecided = [any(z == PLAIN for z, _ in f) for f in found]
            return {"text": [None if u else main_text(f, set()) for f, u in zip(found, undecided)], "open": undecided}

        return scan

    got, s = scan_texts(src.withColumn("ident", ident), "html", first_pass, _TEXT, [id_col, url_col], "page_scan")
    done = got.where(~F.col(f"{s}.open")).select(id_col, url_col, F.col(f"{s}.text").alias("text"))

    rows = src.select(ident.alias("ident"), F.col(url_col).cast("string").alias("u"), "html").mapInArrow(_suffix_rows(run), _SUFFIX)
    # a row without a key stands for a page, so their groups count a host's distinct pages
    met = rows.select("host", "key", "short", "copy").distinct().groupBy("host", "key", "short").agg(F.count("*").alias("n"))
    met, _ = written(pages.sparkSession, met.where("n > 1 or key is null"), "host_suffixes")
    hosts = met.where("key is null").select("host", F.col("n").alias("n_pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    least = F.greatest(F.when(F.col("short"), SHORT_PAGES).otherwise(2), F.ceil(F.col("n_pages") * SHARE))
    repeated = met.where("key is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"]).where(F.col("n") >= least).select("host", "key")
    places = (
        rows.where("plain and key is not null").dropDuplicates(["ident", "place"]).join(repeated, ["host", "key"])
        .groupBy("ident").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most a page's words
    )
    undecided = _open_pages(src, id_col, url_col).withColumn("ident", ident).join(places, "ident", "left")
    rest = undecided.mapInArrow(_second_pass(run, id_col, url_col), T.StructType([undecided.schema[id_col], undecided.schema[url_col], T.StructField("text", T.StringType())]))
    return done.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


def _open_pages(src: DataFrame, id_col: str, url_col: str) -> DataFrame:
    flag = T.StructType([T.StructField("open", T.BooleanType())])
    got, s = scan_texts(src, "html", lambda: lambda raws: {"open": [any(z == PLAIN for z, _ in _parsed(r)) for r in raws]}, flag, [id_col, url_col, "html"], free_name(src.columns, "page_open"))
    return got.where(F.col(f"{s}.open")).drop(s)


def _second_pass(run: int, id_col: str, url_col: str):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            out = []
            for html, starts in zip(col("html").to_pylist(), col("places").to_pylist()):
                out.append(main_text(blocks(html or ""), set(starts or ()), run))
            yield pa.RecordBatch.from_arrays([col(id_col), col(url_col), pa.array(out, pa.string())], names=[id_col, url_col, "text"])

    return texts
