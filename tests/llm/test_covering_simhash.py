import itertools
from collections import defaultdict

import numpy as np
import xxhash
from helpers import AWKWARD, docs_of, sf

from flipframe.llm import covering_simhash as C
from flipframe.llm.components import connected


def brute_fp(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, radius=2):
    """fps: list of (doc_id, fp); component id per row."""
    ids = defaultdict(list)
    for i, f in fps:
        ids[f].append(i)
    keys, parent = list(ids), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    arr = np.array(keys, np.uint64)
    for k, f in enumerate(keys):
        near = np.flatnonzero(np.bitwise_count(arr[k + 1 :] ^ np.uint64(f)) <= radius)
        for j in near:
            parent[find(keys[k + 1 + int(j)])] = find(f)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[find(f)].append(i)
    return sorted(((i, f"{f:016x}", min(least[find(f)], default=None)) for i, f in fps), key=str)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (2, 4):
        hidden = [set(h) for h in C.hidden_bits(radius)]
        assert len(hidden) == 2 ** (radius + 1) - 1
        bits = 64 if radius == 2 else 16
        assert all(any(set(p) <= h for h in hidden) for k in range(radius + 1) for p in itertools.combinations(range(bits), k))


def test_links_connect_exactly_what_is_near(spark):
    r = np.random.default_rng(11)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for b in base:
        x = int(b)
        for _ in range(60):
            fps.add(x)
            for bit in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(bit)
            if r.random() < 0.3:
                x = int(b)
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "doc_id long, fp long")
    got = {x.fp & (2**64 - 1): x.component_id for x in C.fingerprint_classes(df).collect()}
    assert sorted(((k, f"{f:016x}", got[f]) for k, f in rows), key=str) == brute_components(rows)


def test_documents_equal_brute_force(spark):
    d = sf(spark, "documents", "/root/testdata/sf0.1")
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in d.select("doc_id", "text").limit(2500).collect()])
    got = C.near_duplicates(d.limit(2500))
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want


def test_awkward_rows(spark):
    texts, ids = [*AWKWARD, "a b", "A  b", "same text here"], [*range(len(AWKWARD)), 50, 40, None]
    d = docs_of(spark, texts, ids)
    got = C.near_duplicates(d).collect()
    assert sorted(map(tuple, got), key=str) == brute_components([(i, brute_fp(t)) for i, t in zip(ids, texts)])
    assert C.near_duplicates(d.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    d = sf(spark, "documents")
    groups = {r.component_id for r in C.near_duplicates(d).collect()}
    kept = C.keep_one_each(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    texts, ids = ["t u v", "t u v", "t u v", None, "", "p q", "p q", "lone", "lone"], [4, 4, 9, 3, 2, None, None, 7, None]
    kept = C.keep_one_each(docs_of(spark, texts, ids))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, "t u v"), (2, ""), (None, "p q"), (7, "lone")], key=str)
    assert C.keep_one_each(docs_of(spark, [])).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 90)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in edges]], "u long, v long")
    got = {r.node: r.root for r in connected(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 90)}, **{k: 200 for k in (200, 201, 202)}}
    assert connected(df.limit(0)).count() == 0
