from collections import defaultdict

import numpy as np
from helpers import sf

from flipframe.llm import grid_order_join as G

SCHEMA = "vec_id long, embedding array<float>, label int, proj string, pos int"


def brute(rows, cosine=0.93):
    ok = [k for k, (_, e, l) in enumerate(rows) if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, parent = defaultdict(int), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = defaultdict(list)
    for k in ok:
        groups[rows[k][2], len(rows[k][1])].append(k)
    for ks in groups.values():
        m = np.array([rows[k][1] for k in ks], np.float32).astype(float)
        norm = np.sqrt((m * m).sum(1))
        s = (m @ m.T) / norm[:, None] / norm[None]
        for i, j in zip(*np.nonzero(s >= cosine)):
            if i < j:
                links[ks[i]] += 1
                links[ks[j]] += 1
                parent[find(ks[i])] = find(ks[j])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        least[r] = i if r not in least else min(least[r], i)
    return sorted((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def clusters(seed, n=700, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(25, d))
    rows = [(k, (centres[r.integers(25)] + r.normal(size=d) * r.choice([0.1, 0.25, 0.6])).astype(np.float32).tolist(), int(r.integers(3))) for k in range(n)]
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(200)]
    return rows


def test_clusters_equal_brute_force(spark):
    rows = clusters(1)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    for block, cosine in ((32, 0.93), (512, 0.93), (64, 0.99), (64, 0.5)):
        got = sorted(tuple(r) for r in G.near_vectors(df, cosine=cosine, block=block).collect())
        assert got == brute(rows, cosine), (block, cosine)


def test_embeddings_equal_brute_force(spark):
    e = sf(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r.vec_id, r.embedding, r.label) for r in e.collect()]
    assert sorted(tuple(r) for r in G.near_vectors(e).collect()) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [1e-30, 0.0], [-1.0, 0.0], [1.0, 0.1]]
    rows = [(k, v, 1) for k, v in enumerate(vecs)] + [(90, [1.0, 0.0], None), (91, [1.0, 0.0], 2), (6, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in G.near_vectors(df).collect())
    assert got == brute(rows)
    assert G.near_vectors(df.limit(0)).count() == 0
    assert G.near_vectors(df.where("label is null")).count() == 1


def test_recursion_skips_only_distant_intervals():
    r = np.random.default_rng(4)
    a = np.sort(r.normal(size=(400, 8)), axis=0)
    axes = G.principal_directions(G._unit(a), 3)
    p = G._unit(a) @ axes
    i, j = G.block_links(a, a, p, p, 0.97, True)
    s = G._unit(a) @ G._unit(a).T
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, y in zip(*map(np.ndarray.tolist, np.nonzero(s >= 0.97))) if x < y}


def test_tiny_and_huge_components(spark):
    vecs = [[1e-200, 0.0, 0.0], [3e-200, 0.0, 1e-203], [1e200, 0.0, 0.0], [2e200, 0.0, 0.0], [0.0, 1e200, 1e200], [0.0, 5e-324, 5e-324], [1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vecs)] + [(9, [1e-200, 0.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in G.near_vectors(df).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 6: (4, 0), 4: (1, 4), 5: (1, 4), 9: (0, 9)}
