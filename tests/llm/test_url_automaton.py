import re

import numpy as np
from helpers import sf

from flipframe.llm import url_automaton as U


def glob_regex(g):
    return re.compile("".join({"**": "(?s:.)*", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|[^*]|\*", g)) + r"\Z")


def test_shift_and_equals_regex_on_random_globs():
    r = np.random.default_rng(3)
    for _ in range(60):
        pats = ["".join(r.choice(["a", "b", "/", "*", "**", "é"], r.integers(0, 9))).replace("***", "**") for _ in range(30)]
        pats = [re.sub(r"\*{3,}", "**", p) for p in pats]
        texts = ["".join(r.choice(["a", "b", "/", "é"], r.integers(0, 12))) for _ in range(40)]
        got = U.ShiftAnd(pats).matches([t.encode() for t in texts])
        want = [[bool(glob_regex(p).match(t)) for p in pats] for t in texts]
        assert got.tolist() == want


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    word = any(g.strip("*") in "." + host + path for g in U.BLOCK_GLOBS)
    return host, path, best.text if best else None, best.verdict if best else "block" if word else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/x", "http://xorg/es/", "http://example.org/en/1",
    "http://example.org/EN/1", "http://a.b.example.org/en/12?q#f", "http://example.org?x=/es/", "http://x.com/fr/", "http://x.com/de/a#b",
    "http://com/de/", "http://a.net/x.org/es/", "http://a.net/.com/de/", "http://casino.net/", "http://ÄB.org/ü", "a://b.com/fr/://c", "http://h/" + "y" * 30000,
    "http://x.com/fr/casino",
]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}
    assert U.url_verdicts(df.limit(0)).count() == 0


def test_pages_against_brute_force(spark):
    pages = sf(spark, "pages", "/root/testdata/sf0.1")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(pages).collect()}
    assert got == {i: brute(u) for i, u in urls.items()}
