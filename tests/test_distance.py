import pytest
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens
from flipframe.operators import distance as D


def test_token_edit_distance_golden(spark):
    df = spark.createDataFrame([("the cat sat on", "the big cat on"), ("a b", "a b"), ("", "x y")], "a string, b string")
    df = df.select(word_tokens("a").alias("a"), word_tokens("b").alias("b"))
    out = D.with_token_edit_distance(df, "a", "b").withColumn("norm", D.normalised_distance(F.col("distance"), F.col("a")))
    got = sorted(((r.distance, r.norm) for r in out.collect()), key=repr)
    assert got == sorted([(0, 0.0), (2, 0.5), (2, None)], key=repr)


def test_numpy_path_agrees_with_native(spark):
    import random

    rnd = random.Random(3)
    rows = [([rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))], [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))])
            for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    native = [r[0] for r in df.select(D.token_edit_distance_native(F.col("a"), F.col("b"))).collect()]
    assert native == [D._lev_np(a, b) for a, b in rows]
    udf = [r[0] for r in df.select(D.token_edit_distance_udf("a", "b")).collect()]
    assert udf == native


def test_tree_edit_distance_classic_example():
    a = D.parse_bracketed("(f (d (a) (c (b))) (e))")
    b = D.parse_bracketed("(f (c (d (a) (b))) (e))")
    assert D.tree_edit_distance(a, b) == 2
    assert D.tree_edit_distance(a, a) == 0


def test_tree_rows_pad_shorter_side(spark):
    t = spark.createDataFrame([(1, 0, ["(S (T a))", "(S (T b))"], ["(S (T a))"])],
                              "paired_id long, idx int, ref_trees array<string>, gen_trees array<string>")
    r = D.tree_distance_rows(t).first()
    pad = D.tree_edit_distance(D.parse_bracketed("(S (T b))"), D.parse_bracketed(D.PAD_TREE))
    assert r.tree_distance == pytest.approx((0 + pad) / 2)


def test_flat_tree_distance_closed_forms():
    """For one-level trees (S (T t1) ... (T tk)) Zhang-Shasha equals a token edit distance with
    substitution 1 and insert/delete 2; against the '.' pad tree it is 3 (empty) or 2k (+1 without
    a '.' token). The SQL oracle relies on both."""
    import random

    def flat(toks):
        return "(S " + " ".join(f"(T {t})" for t in toks) + ")"

    def wlev(a, b):
        prev = [2 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            cur = [2 * i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 2, cur[j - 1] + 2, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    rnd = random.Random(5)
    alpha = ["a", "b", ".", "T", "S", "ROOT"]
    for _ in range(300):
        a = [rnd.choice(alpha) for _ in range(rnd.randint(0, 5))]
        b = [rnd.choice(alpha) for _ in range(rnd.randint(0, 5))]
        assert D.tree_edit_distance(D.parse_bracketed(flat(a)), D.parse_bracketed(flat(b))) == wlev(a, b)
        pad = 3 if not a else 2 * len(a) + (0 if "." in a else 1)
        assert D.tree_edit_distance(D.parse_bracketed(flat(a)), D.parse_bracketed(D.PAD_TREE)) == pad


def _plain_tree_distance(a, b):
    """Forest recursion straight from the definition, for small trees."""
    from functools import cache

    @cache
    def size(f):
        return sum(1 + size(kids) for _, kids in f)

    @cache
    def dist(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, fx), (y, gy) = f[-1], g[-1]
        return min(dist(f[:-1] + fx, g) + 1, dist(f, g[:-1] + gy) + 1, dist(f[:-1], g[:-1]) + dist(fx, gy) + (x != y))

    def frozen(t):
        return (t[0], tuple(frozen(k) for k in t[1]))

    return dist((frozen(a),), (frozen(b),))


def test_nested_trees_equal_the_definition():
    import random

    rnd = random.Random(9)

    def tree(depth):
        return (rnd.choice("abc"), [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else [])

    for _ in range(400):
        a, b = tree(3), tree(3)
        assert D.tree_edit_distance(a, b) == _plain_tree_distance(a, b), (a, b)


def test_deep_and_wide_trees():
    deep = "(a " * 3000 + "x" + ")" * 3000
    assert D.tree_edit_distance(D.parse_bracketed(deep), D.parse_bracketed("(a x)")) == 2999
    wide = D.parse_bracketed("(S " + " ".join(f"w{i}" for i in range(4000)) + ")")
    other = D.parse_bracketed("(S " + " ".join(f"w{i}" for i in range(1, 4001)) + ")")
    assert D.tree_edit_distance(wide, other) == 2


def test_aligned_sentences_equal_their_trees(spark):
    """The batched token distances are the tree distances of the sentences' one-level trees."""
    import random

    rnd = random.Random(11)
    line = lambda: [rnd.choice(["a", "b", ".", "c", "d"]) for _ in range(rnd.choice([0, 1, 2, 5, 9, 40]))]
    rows = [(i, i % 3, [line() for _ in range(rnd.randint(1, 5))], [line() for _ in range(rnd.randint(1, 5))]) for i in range(60)]
    rows.append((60, 0, [["x", "y"]], [["x", "y"]]))
    df = spark.createDataFrame(rows, "paired_id long, idx int, ref_lines array<array<string>>, gen_lines array<array<string>>")
    got = {(r.paired_id, r.idx): r.tree_distance for r in D.flat_tree_distance_rows(df).collect()}
    flat = lambda t: "(S " + " ".join(f"(T {w})" for w in t) + ")"
    trees = spark.createDataFrame([(i, k, [flat(t) for t in a], [flat(t) for t in b]) for i, k, a, b in rows],
                                  "paired_id long, idx int, ref_trees array<string>, gen_trees array<string>")
    want = {(r.paired_id, r.idx): r.tree_distance for r in D.tree_distance_rows(trees).collect()}
    assert got == pytest.approx(want) and len(got) == len(rows)


def test_batches_bound_their_cells(monkeypatch):
    import random

    rnd = random.Random(2)
    make = lambda n: D.np.array([rnd.randrange(4) for _ in range(n)])
    a, b = ([make(rnd.randint(0, 12)) for _ in range(80)] for _ in range(2))
    want = [D._lev_np(list(x), list(y)) for x, y in zip(a, b)]
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(D, "FLAT_CELLS", cells)
        assert D.batch_token_distances(a, b, 1).tolist() == want
