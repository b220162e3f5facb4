import hashlib
import re
import string

import numpy as np
from helpers import AWKWARD, docs_of, sf

from flipframe.llm import wu_manber as W

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, bench, width=10):
    wins = [(str(i), tuple(w[k : k + min(width, len(w))])) for i, t in bench if i is not None and (w := words(t)) for k in range(len(w) - min(width, len(w)) + 1)]
    by = {}
    for i, w in wins:
        by.setdefault(w, set()).add(i)
    sizes = {len(w) for w in by}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if who := by.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    ids |= who
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_equal_brute_force(spark):
    d, b = sf(spark, "documents", "/root/testdata/sf0.1"), sf(spark, "benchmark", "/root/testdata/sf0.1")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert sum(r[5] for r in want) > 10
    assert rows_of(W.contamination(d, b)) == want
    kept = W.keep_uncontaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in want)


def test_several_blocks_give_the_same(spark):
    d, b = sf(spark, "documents"), sf(spark, "benchmark")
    one, w1 = W.find_windows(d, b, keep=["doc_id"])
    many, w2 = W.find_windows(d, b, keep=["doc_id"], block_bytes=1500)
    assert rows_of(one.select("doc_id", f"{w1}.*")) == rows_of(many.select("doc_id", f"{w2}.*"))


def test_random_words_short_items_and_overlaps():
    r = np.random.default_rng(5)
    for _ in range(150):
        items = [(str(k), " ".join(r.choice(list("abc"), r.integers(0, 7)))) for k in range(4)]
        text = " ".join(r.choice(list("abc"), r.integers(0, 40)))
        spans, ids = W.search(W.ascii_words(text.encode()), W.windows([(i, t.encode()) for i, t in items], 4))
        want = brute([(0, text)], items, 4)[0]
        assert (sum(s["end"] - s["start"] for s in spans), len(ids)) == want[2:4]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_awkward_rows(spark):
    texts = [*AWKWARD, "Alpha-BETA gamma", "alpha beta", "ÄÖ ä"]
    bench = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "word " * 15), (None, "x"), (5, "x"), (6, "äö"), (10, "alpha")]
    b = spark.createDataFrame([(i, t, "c") for i, t in bench], "item_id long, text string, items string")
    d = docs_of(spark, texts)
    assert rows_of(W.contamination(d, b)) == brute(list(enumerate(texts)), bench)
    assert rows_of(W.contamination(d, b.limit(0))) == brute(list(enumerate(texts)), [])
    assert W.contamination(d.limit(0), b).count() == 0


def test_skewed_items_pack_into_few_blocks(spark):
    rows = [(k, "w%d x%d" % (k, k)) for k in range(150)] + [(999, "long " * 520)]
    b = spark.createDataFrame(rows, "item_id long, text string")
    groups = list(W._blocks(b, 2000))
    assert len(groups) <= 4 and sorted(i for g in groups for i, _ in g) == sorted(str(i) for i, _ in rows)
    d = spark.createDataFrame([(1, "w3 x3 and long long long long long long long long long long"), (2, "w3 x4")], "doc_id long, text string")
    one, w1 = W.find_windows(d, b, keep=["doc_id"])
    many, w2 = W.find_windows(d, b, keep=["doc_id"], block_bytes=2000)
    assert sorted(map(str, one.select("doc_id", f"{w1}.*").collect())) == sorted(map(str, many.select("doc_id", f"{w2}.*").collect()))
