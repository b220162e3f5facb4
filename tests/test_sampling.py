from pyspark.sql import functions as F

from flipframe.operators import corpus as CO
from flipframe.operators import sampling as S


def test_kfold_sizes_disjoint_complete(spark):
    df = spark.range(13).withColumnRenamed("id", "rid")
    kf = S.kfold(df, "rid", 2022, k=5, val_frac=0.15)
    tests = kf.filter("split = 'test'").groupBy("fold").count().orderBy("fold").collect()
    assert sorted(r["count"] for r in tests) == [2, 2, 3, 3, 3]
    ids = [r.rid for r in kf.filter("split = 'test'").collect()]
    assert sorted(ids) == list(range(13))
    assert kf.count() == 13 * 5


def test_exact_sample_half_even(spark):
    for n, expect in ((10, 2), (30, 4)):
        df = spark.range(n).withColumnRenamed("id", "rid")
        assert S.exact_sample(df, "rid", 1, frac=0.15).count() == expect


def test_rank_independent_of_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "rid")
    a = {r.rid: r["rank"] for r in S.hash_rank(df.repartition(1), "rid", 9).collect()}
    b = {r.rid: r["rank"] for r in S.hash_rank(df.repartition(13), "rid", 9).collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def test_split_complement_disjoint(spark):
    df = spark.range(100).withColumnRenamed("id", "rid")
    samp = S.exact_sample(df, "rid", 4, frac=0.3)
    comp = S.complement(df, samp, "rid")
    assert samp.count() + comp.count() == 100
    assert samp.join(comp, "rid").count() == 0


def test_balanced_sample_per_class(spark):
    df = spark.range(300).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in S.balanced_sample(df, "rid", "y", 5, 40).groupBy("y").count().collect()}
    assert got == {0: 40, 1: 40}


def test_row_numbering(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 100, 7)], "k long")
    got = {r.k: r.row_id for r in S.row_numbering(df, "k").collect()}
    assert got == {3: 0, 5: 1, 7: 2, 100: 3}


def test_blocks_drop_partial(spark):
    lines = spark.createDataFrame([(0, "a b c d e f"), (1, "g h i j")], "line_id long, text string")
    toks = CO.tokenize_lines(lines)
    vocab = CO.build_vocab(toks)
    enc = CO.encode_lines(toks, vocab)
    blocks = CO.pack_blocks(CO.ids_arrays(enc), CO.line_offsets(toks), 4).orderBy("block_id").collect()
    assert [len(b.ids) for b in blocks] == [4, 4]


def test_value_rank_quantile_buckets_on_clustered_keys(spark):
    keys = list(range(0, 50)) + list(range(10**9, 10**9 + 50)) + [2**40]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r["rank"] for r in S.value_rank(df, "k", n_parts=8).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_skewed_group_ranks_are_exact(spark):
    # one class holds 90 % of the rows; ranks inside every class must still be 0..n-1
    df = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    r = S.hash_rank(df, "rid", 5, by=["y"], size_col="n")
    for y, n in ((0, 2700), (1, 300)):
        got = sorted(x["rank"] for x in r.filter(F.col("y") == y).collect())
        assert got == list(range(n))


def test_pair_assign_with_a_huge_pair(spark):
    from flipframe.operators.pairs import assign_counterfactual

    # pair 0 holds a third of all rows; every pair still gets exactly one counterfactual
    df = spark.range(900).select(F.col("id").alias("row_id"),
                                 F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("paired_id"))
    a = assign_counterfactual(df, "paired_id", "row_id", 1)
    per = {r.paired_id: r.s for r in a.groupBy("paired_id").agg(F.sum("is_counterfactual").alias("s")).collect()}
    assert set(per.values()) == {1} and len(per) == 601


def test_blocks_keep_stream_order_past_2_31_tokens(spark):
    # offsets as of a corpus with billions of tokens before these lines
    for base in (2**31, 3 * 2**31):
        start = base - 200
        rows = [(0, list(range(300)), start, 300), (1, list(range(1000, 1500)), start + 300, 500), (2, list(range(5000, 6200)), start + 800, 1200)]
        df = spark.createDataFrame(rows, "line_id long, ids array<int>, start long, n_tokens long")
        before = spark.createDataFrame([(-1, 0, start)], "line_id long, start long, n_tokens long")
        offs = before.unionByName(df.select("line_id", "start", "n_tokens"))
        stream = [i for r in rows for i in r[1]]
        for r in CO.pack_blocks(df.select("line_id", "ids"), offs, 510).collect():
            lo = r.block_id * 510 - start
            assert r.ids == stream[max(lo, 0):lo + 510]


def test_samples_and_splits_equal_full_ranks(spark):
    df = spark.range(4000).select(F.col("id").alias("rid"), (F.col("id") % 7 == 0).cast("int").alias("y"), F.lit("t").alias("text"))
    full = {r.rid: (r["rank"], r.n) for r in S.hash_rank(df, "rid", 3, by=["y"], size_col="n").collect()}
    for n, frac in ((0, None), (1, None), (37, None), (10**6, None), (None, 0.31), (None, 1.0)):
        want = {i for i, (r, size) in full.items() if r < (min(n, size) if n is not None else round(frac * size))}
        assert {r.rid for r in S.exact_sample(df, "rid", 3, n=n, frac=frac, by=["y"]).collect()} == want
        marked = S.mark_sample(df, "rid", 3, n=n, frac=frac, by=["y"]).collect()
        assert len(marked) == 4000 and {r.rid for r in marked if r.in_sample} == want


def test_poisson_tail_and_exact_draws(spark):
    import math

    for lam in (0.0, 0.5, 200.0, 800.0):
        t = S.poisson_thresholds(lam)
        assert abs(t[-1] - 1.0) < 1e-9 and t == sorted(t)
        mean = sum(j * p for j, p in enumerate([t[0]] + [b - a for a, b in zip(t, t[1:])]))
        assert math.isclose(mean, lam, abs_tol=1e-6)
    df = spark.range(50).withColumnRenamed("id", "rid")
    d = S.draw_with_replacement(df, "rid", 1, n=500).collect()
    assert len(d) == 500 and sorted(r.draw for r in d) == list(range(500)) and len({r.rid for r in d}) == 50
    assert S.draw_with_replacement(df.limit(0), "rid", 1, frac=0.5).count() == 0


def test_position_of_any_doubles(spark):
    from flipframe.operators.metrics import mid_ranks

    vals = [1e-300, 5.0, 5.0, 20862.0, 1e9, 1e300, -1e300, 0.0]
    df = spark.createDataFrame([(0, v) for v in vals] + [(1, 2.0)], "g int, v double")
    got = sorted((r.g, r.v, r.k) for r in mid_ranks(df, "v", ["g"], "k").collect())
    rank = lambda v: sum(w < v for w in vals) + (vals.count(v) + 1) / 2
    assert got == sorted([(0, v, rank(v)) for v in vals] + [(1, 2.0, 1.0)])


def test_one_pass_pivot_equals_assignment_and_pivot(spark):
    from flipframe.operators.pairs import assign_counterfactual, pivot_pairs, pivot_seeded

    rows = [(i, i // 2, f"<b>t{i}</b> &amp; x", i % 2) for i in range(40)] + [(100, 60, "alone", 1), (101, 61, "a", 0), (102, 61, "b", 1), (103, 61, "c", 0), (104, 62, None, 1), (105, 62, "d", 0)]
    df = spark.createDataFrame(rows, "row_id long, paired_id long, text string, sentiment int")
    want = pivot_pairs(assign_counterfactual(df, "paired_id", "row_id", 3))
    got = pivot_seeded(df, "row_id", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_lots_encode_as_rows_per_token_do(spark, monkeypatch):
    """Repeated, null and empty lines, unknown tokens, more lots than one: the arrays of the long form, without it."""
    monkeypatch.setattr(CO, "LOT_TOKENS", 7)
    monkeypatch.setattr(CO, "encode_lines", None)
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(i % 9))) for i in range(40)]
    rows += [(3, "twice w1 w0"), (None, "no id"), (None, "w2 w2"), (41, None), (42, ""), (43, "a b c (x)\ny")]
    toks = CO.tokenize_lines(spark.createDataFrame(rows, "line_id long, text string"))
    vocab = spark.createDataFrame([(f"w{k}", k + 6) for k in range(11)] + [("(", 20)], "token string, id int")
    code = {r.token: r.id for r in vocab.collect()}
    want = {}
    for r in toks.collect():
        for pos, t in enumerate(r.tokens or []):
            want.setdefault(r.line_id, []).append((pos, code.get(t, 1)))
    got = CO.encode_arrays(toks, vocab).collect()
    assert len(got) == len(want) and {r.line_id: r.ids for r in got} == {k: [i for _, i in sorted(v)] for k, v in want.items()}


def test_no_token_holds_the_blank_that_joins_a_line(spark):
    got = CO.tokenize_lines(spark.createDataFrame([(1, "a  b\t c  d \n")], "line_id long, text string")).first().tokens
    assert all(" " not in t for t in got) and " " in got
