from collections import defaultdict

import numpy as np
from helpers import sf

from flipframe.llm import pruned_graph as P

SCHEMA = "vec_id long, embedding array<{}>, label int, shard string, dim int, ids string"


def cosines(v, q):
    v, q = P.scaled(v), P.scaled(q)
    return (q @ v.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((v * v).sum(1))


def usable(rows):
    return sorted({(i, tuple(x + 0.0 for x in e)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}, key=repr)


def brute(rows, queries, k=5):
    """{query id: [(score, id)] of all candidates, best first}"""
    out = {}
    rows = usable(rows)
    for qid, q in usable(queries):
        near = [(i, e) for i, e in rows if len(e) == len(q) and i != qid]
        s = cosines(np.array([e for _, e in near], float), np.array([q], float))[0] if near else []
        out[qid] = sorted(((float(x), i) for x, (i, _) in zip(s, near)), key=lambda p: (-p[0], p[1]))
    return out


def answers(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def checked(got, want, k=5):
    """Scores are exact, answers ordered, never the query's own; returns the recall."""
    hit = total = 0
    for q, near in want.items():
        exact, best = defaultdict(list), near[:k]
        for s, i in near:
            exact[i].append(s)
        assert len(got[q]) == min(k, len(near)) and all(min(abs(x - s) for x in exact[i]) < 1e-12 for s, i in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[0], p[1])) and q not in {i for _, i in got[q]}
        hit += len({i for _, i in got[q]} & {i for _, i in best})
        total += len(best)
    assert set(got) <= set(want)
    return hit / max(1, total)


def test_recall_on_embeddings(spark):
    e = sf(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    queries = [r for r in rows if r[0] % 50 == 0]
    q = e.where("vec_id % 50 = 0")
    assert checked(answers(P.nearest_vectors(e, q)), brute(rows, queries)) >= 0.95
    assert checked(answers(P.nearest_vectors(e, q, shard=300)), brute(rows, queries)) >= 0.95


def test_recall_and_reach_on_hard_vectors():
    r = np.random.default_rng(2)
    spread = r.normal(size=(3000, 48))
    centres = r.normal(size=(40, 48)) * 10
    tight = centres[r.integers(40, size=3000)] + 0.01 * r.normal(size=(3000, 48))
    for v in (spread, tight):
        x = P.unit(v)
        links, entries = P.build_graph(x)
        assert P._reached(links, entries.tolist()).all()
        near, score = P.search_graph(v, x, links, entries, v[:200], P.SEARCH_BEAM)
        want = np.argsort(-cosines(v, v[:200]), axis=1, kind="stable")[:, :6]
        top = np.take_along_axis(near, np.argsort(-score, axis=1, kind="stable")[:, :6], 1)
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(top.tolist(), want.tolist())]) >= 0.9


def test_pruned_edges_are_diverse():
    r = np.random.default_rng(5)
    x = P.unit(r.normal(size=(300, 8)))
    near = np.tile(np.arange(300), (20, 1))
    out = P.robust_prune(x, np.arange(20), near, 16, 1.2)
    for p in range(20):
        mine = [c for c in out[p].tolist() if c >= 0]
        d = lambda a, b: max(0.0, 2 - 2 * float(x[a] @ x[b]))
        left = sorted((c for c in range(300) if c != p), key=lambda c: d(p, c))
        want = []
        while left and len(want) < 16:
            want.append(left[0])
            left = [c for c in left[1:] if 1.2 * d(want[-1], c) > d(p, c)]
        assert mine == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1.0, 0.0, 0.0],
            [1e-200, 0.0], [-1.0, 0.0], [1.0, 0.1], [1e200, 2e200], [2e200, 4e200], [5e-324, 0.0]]
    rows = [*enumerate(vecs), *[(100 + k, [0.5, 0.5]) for k in range(30)], (6, [0.0, 1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, "c", 2, "i") for r in rows], SCHEMA.format("double"))
    queries = [r for r in rows if r[0] not in (6,)]  # id 6 has two vectors: its answers are checked below
    want = brute(rows, queries)
    assert checked(answers(P.nearest_vectors(df, df.where("vec_id <> 6"), shard=4)), want) == 1.0
    both = P.nearest_vectors(df, df.where("vec_id = 6"))
    assert both.count() == 10 and both.where("vec_id = 6").count() == 0
    assert P.nearest_vectors(df.limit(0), df).count() == 0
    assert P.nearest_vectors(df, df.limit(0)).count() == 0
    assert P.nearest_vectors(df.where("vec_id = 9"), df.where("vec_id = 9")).count() == 0


def test_large_group_of_copies_breaks_ties_by_id(spark):
    r = np.random.default_rng(7)
    rows = [(k, r.normal(size=6).astype(np.float32).tolist()) for k in range(200)]
    rows += [(1000 - k, rows[3][1]) for k in range(500)]
    df = spark.createDataFrame([(*x, 1, "c", 2, "i") for x in rows], SCHEMA.format("float"))
    got = answers(P.nearest_vectors(df, df.where("vec_id in (3, 501, 700)")))
    assert [i for _, i in got[3]] == [501, 502, 503, 504, 505]
    assert [i for _, i in got[501]] == [3, 502, 503, 504, 505]
    assert [i for _, i in got[700]] == [3, 501, 502, 503, 504]
