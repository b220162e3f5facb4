import math
from collections import Counter, defaultdict

import numpy as np
from helpers import AWKWARD, docs_of, sf

from flipframe.llm import interval_search as I
from flipframe.llm.common import ascii_words


def words(t):
    return ascii_words(None if t is None else t.encode())


def brute(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, t in items:
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in set(words(t)) if w in b)
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(*a, **kw):
    return sorted((tuple(r) for r in I.ranked_documents(*a, **kw).collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "item_id long, text string, term string, score double")


def test_documents_equal_brute_force(spark):
    d, b = sf(spark, "documents", "/root/testdata/sf0.001"), sf(spark, "benchmark", "/root/testdata/sf0.001")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert got(d, b) == want
    assert got(d.repartition(3), b, segment_docs=7, query_block=8) == want  # many segments and blocks


def test_ties_copies_and_awkward_rows(spark):
    texts = [*AWKWARD, *["same text here"] * 40, *[f"word x{k % 3} same" for k in range(30)], "The the THE mit", "text " * 500]
    ids = [None, *range(300, 300 - len(texts) + 2, -1), 290]  # a null id, a repeated one, descending order
    d = docs_of(spark, texts, ids)
    rows = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (None, "the mit license"), (5, "zzz unseen"), (6, "x1 word " * 2000), (7, "a" * 70_000)]
    want = brute(list(zip(ids, texts)), rows)
    for docs in (3, 1000):
        assert got(d, items_of(spark, rows), segment_docs=docs, query_block=2) == want
    assert got(d.limit(0), items_of(spark, rows)) == []
    assert got(d, items_of(spark, rows).limit(0)) == []


def test_search_scores_few_documents_and_equals_a_scan():
    r = np.random.default_rng(3)
    n_docs, n_lists = 5000, 12
    lists = [np.sort(r.choice(n_docs, int(n_docs * p), False)) for p in r.uniform(0.01, 0.3, n_lists)]
    size = np.array([len(x) for x in lists])
    end = np.cumsum(size)
    key = np.repeat(np.arange(n_lists), size) * n_docs + np.concatenate(lists)
    value = r.integers(1, 1000, len(key)) * np.where(r.random(len(key)) < 0.01, 50, 1)
    weights = r.integers(1, 50, n_lists)
    maxima = I.RangeMaxima(value, int(size.max()))
    score = np.zeros(n_docs, np.int64)
    np.add.at(score, key % n_docs, value * weights[key // n_docs])
    want = np.lexsort((np.arange(n_docs), -score))[:10]
    d, s, scored = I.best_documents(maxima, key, n_docs, end - size, end, weights, n_docs, 10)
    assert d.tolist() == want.tolist() and s.tolist() == score[want].tolist()
    assert scored < n_docs / 2
    floor = int(score[want[4]])
    d, s, _ = I.best_documents(maxima, key, n_docs, end - size, end, weights, n_docs, 10, floor)
    assert d.tolist() == [x for x in want.tolist() if score[x] >= floor]


def test_range_maxima_equal_a_scan():
    r = np.random.default_rng(1)
    v = r.integers(0, 50, 300)
    m = I.RangeMaxima(v, 300)
    a, b = zip(*[sorted(r.choice(301, 2, False)) for _ in range(400)])
    at = m.best(np.array(a), np.array(b))
    assert [int(v[i]) for i in at] == [int(v[x:y].max()) for x, y in zip(a, b)]
    assert all(x <= i < y for i, x, y in zip(at, a, b))


def test_terms_outside_the_queries_are_not_indexed(spark):
    d = docs_of(spark, ["alpha beta gamma"] * 3)
    bits = np.zeros(I.BITMAP, bool)
    bits[I._bits([b"beta"])] = True
    rows = I.posting_segments(d, "doc_id", "text", bits).collect()
    assert {r.term for r in rows} <= {None, "beta"}
    assert defaultdict(int, {r.term: r.df for r in rows})[None] >= 1
