import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import AWKWARD, docs_of, sf

from flipframe.llm import butterfly_manifest as B


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes, fanout):
    """Root, and for each leaf the siblings by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            s = k // fanout * fanout
            paths[i].append((nodes[s:k], nodes[k + 1 : s + fanout]))
        nodes = [sha("".join(nodes[s : s + fanout])) for s in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], paths


def brute(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    built = {s: tree([x[2] for x in groups[s]], fanout) for s in order}
    if not order:
        return []
    root, tops = tree([built[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        sub, paths = built[s]
        for (_, _, h, r), path in zip(groups[s], paths):
            hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if hit else r.text
            acc = leaf(r, low)
            for a, b in path + top:
                acc = sha("".join(a) + acc + "".join(b))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path + top))
            out.append((r.doc_id, h, sub, root, proof, acc, acc == root))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in B.checked_manifest(df, **kw).collect()), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (3, 1)])
def test_documents_equal_brute_force(spark, fanout, levels):
    d = sf(spark, "documents", "/root/testdata/sf0.001")
    assert got(d, fanout=fanout, levels=levels) == brute(d.collect(), fanout)


@pytest.mark.parametrize("sizes", [[1], [33], [300, 1, 2, 16, 3, 40], [1] * 37 + [90]])
def test_ragged_sources(spark, sizes):
    rows = [(i * 1000 + k, "Text %d" % k, "en", "s%d" % i if i else None, k) for i, n in enumerate(sizes) for k in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(d, fanout=4, levels=1) == brute(d.collect(), 4)


def test_awkward_rows(spark):
    d = docs_of(spark, [*AWKWARD, None, "Same", "Same"], [None, *range(1, len(AWKWARD)), 3, 9, 9])
    d = d.withColumnsRenamed({"score": "node", "fp": "key", "part": "proof"})
    assert got(d) == brute(d.collect())
    assert B.checked_manifest(d.limit(0)).count() == 0


def test_only_changed_rows_fail(spark):
    d = sf(spark, "documents", "/root/testdata/sf0.001")
    text = {r.doc_id: r.text for r in d.collect()}
    for r in B.checked_manifest(d).collect():
        t = text[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and t is not None and any("A" <= c <= "Z" for c in t)
        assert r.verified == (not changed)
