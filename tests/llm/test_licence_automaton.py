import re

import numpy as np
from helpers import AWKWARD, docs_of, sf
from test_wu_manber import words

from flipframe.llm import licence_automaton as L


def base(text):
    w, found = words(text), []
    for p, label in L.PHRASES:
        q = p.split()
        found += [(k, label) for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
    at = [k for k, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check(spark_rows, texts):
    for r in spark_rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_documents_equal_brute_force(spark):
    d = sf(spark, "documents", "/root/testdata/sf0.1")
    texts = {r.doc_id: r.text for r in d.collect()}
    rows = L.licence_scan(d).collect()
    assert len(rows) == len(texts) and sum(r.n_base > 0 for r in rows) > 50
    check(rows, texts)


def test_matching_statistics_equal_brute_force():
    r = np.random.default_rng(7)
    for _ in range(80):
        strings = ["".join(r.choice(list("abc"), r.integers(1, 12))) for _ in range(4)]
        sam = L.SuffixAutomaton([[ord(c) for c in s] for s in strings])
        subs = {s[i:j] for s in strings for i in range(len(s)) for j in range(i, len(s) + 1)}
        for s in subs:
            v = 0
            for c in s:
                v = sam.next[v][ord(c)]
            if s:
                ends = {(k, m.start() + len(s)) for k, t in enumerate(strings) for m in re.finditer(f"(?={s})", t)}
                assert sam.ends[v] == ends
        text, v, run = "".join(r.choice(list("abcd"), 40)), 0, 0
        for i, c in enumerate(text):
            while v and ord(c) not in sam.next[v]:
                v = sam.link[v]
                run = sam.length[v]
            if ord(c) in sam.next[v]:
                v, run = sam.next[v][ord(c)], run + 1
            else:
                v = run = 0
            assert run == max(n for n in range(i + 2) if text[i + 1 - n : i + 1] in subs)


def test_templates_with_edits_get_labels():
    scan = L.LicenceScanner(L.PHRASES, L.TEMPLATES)
    for label, text in L.TEMPLATES:
        got = scan.judge(f"some code {text} more code".encode())
        assert label in got["labels"].split(",") and got["score"] == 1.0
    bsd = dict(L.TEMPLATES)["bsd"]
    edited = bsd.replace("modification", "any changes").replace("retain", "also retain")
    got = scan.judge(edited.encode())
    assert got["labels"] == "bsd" and L.MIN_COVER <= got["score"] < 1 and got["n_base"] == 0
    assert scan.judge(b"redistribution and use in source and binary forms are fine")["labels"] == ""


def test_awkward_rows(spark):
    texts = [*AWKWARD, "mit license MIT-License cc by cc by", "gnu general public gnu general public license", "apache licenses", "the cc by"]
    rows = L.licence_scan(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert L.licence_scan(docs_of(spark, [])).count() == 0


def test_every_copy_of_a_notice_is_a_span(spark):
    scan = L.LicenceScanner(L.PHRASES, L.TEMPLATES)
    for label, text in L.TEMPLATES:
        n = len(words(text))
        apart = scan.judge(f"one {text} two {text.lower()} three {text}".encode())
        assert [(x["start"], x["end"], x["share"]) for x in apart["spans"] if x["label"] == label] == [(k * (n + 1) + 1, (k + 1) * (n + 1), 1.0) for k in range(3)]
        joined = scan.judge(f"{text} {text} {text}".encode())
        assert [(x["start"], x["end"]) for x in joined["spans"] if x["label"] == label] == [(k * n, (k + 1) * n) for k in range(3)]
        assert joined["labels"] == scan.judge(text.encode())["labels"] and joined["score"] == 1.0
    isc, mpl = dict(L.TEMPLATES)["isc"], dict(L.TEMPLATES)["mpl"]
    edited = isc.replace("any purpose", "each and every purpose")
    rows = L.licence_scan(docs_of(spark, [f"{isc} {mpl} {edited} code code {mpl} {isc}", "no notice here"])).collect()
    assert [x["label"] for x in rows[0].spans] == ["isc", "mpl", "isc", "mpl", "isc"] and rows[1].spans == []
