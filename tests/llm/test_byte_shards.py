import zlib
from collections import defaultdict

from helpers import AWKWARD, docs_of, sf

from flipframe.llm.byte_shards import byte_shards


def brute(rows, shards=16):
    """Shard by the middle of each row's bytes in (id, checksum, size) order."""
    keyed = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows]
    keyed.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
    total, at, out, slots = sum(k[2] for k in keyed), 0, [], defaultdict(int)
    for i, c, n in keyed:
        s = min(shards - 1, shards * (2 * at + n) // (2 * total))
        out.append((i, n, c, s, slots[s]))
        slots[s] += 1
        at += n
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = byte_shards(df).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    return got


def test_equals_brute_force_and_is_balanced(spark):
    got = check(sf(spark, "documents", "/root/testdata/sf0.1"))
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r["size"]
    mean, most = sum(size.values()) / 16, max(r["size"] for r in got)
    assert len(size) == 16 and all(abs(s - mean) <= most for s in size.values())


def test_partitioning_does_not_change_shards(spark):
    df = sf(spark, "documents")
    a = sorted(map(str, byte_shards(df).collect()))
    assert a == sorted(map(str, byte_shards(df.repartition(7)).collect()))


def test_awkward_rows(spark):
    check(docs_of(spark, AWKWARD + AWKWARD, [None, 1, 1, 1, 5, 6, 7, 8, 9, 9] * 2))
    check(docs_of(spark, ["one"]))
    assert byte_shards(docs_of(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = byte_shards(sf(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
