import random
from collections import Counter

from pyspark.sql import functions as F

from flipframe.operators import scores as S
from flipframe.operators.distance import _lev_np, bit_parallel_distance


def test_bit_parallel_distance_is_the_edit_distance():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(0, 90))] for _ in range(2))
        assert bit_parallel_distance(a, b) == _lev_np(a, b)


def test_candidate_scores_match_counters_and_shuffle_nothing(spark):
    rnd = random.Random(5)
    text = lambda: None if rnd.random() < 0.1 else "\n".join(" ".join(rnd.choice("abc.") for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(1, 4)))
    rows = [(i, text(), text(), [(j, text()) for j in sorted(rnd.choice([0, 1, 2]) for _ in range(rnd.randrange(1, 5)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, example string, counterfactual string, cands array<struct<idx:int,generated:string>>").repartition(3)
    long = S.candidate_rows(df, ["id"], lines=True)
    plan = S.candidate_scores(long, ["id"], True, True)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the test's own repartition
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # pairs go on from batch to batch
    try:
        got = {(r.id, r.place): r for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    tok = lambda t: (t or "").split()
    assert len(got) == sum(len(c) for *_, c in rows)

    def counts(texts, n):
        return sum((Counter(tuple(tok(t)[k : k + n]) for k in range(len(tok(t)) - n + 1)) for t in texts), Counter())

    for i, seed, gold, cands in rows:
        by = {j: [t for k, t in cands if k == j] for j, _ in cands}
        for place, (j, t) in enumerate(cands):
            r = got[i, place]
            assert r.idx == j and r.n_tokens == (None if t is None else len(tok(t))) and r.n_seed == (None if seed is None else len(tok(seed)))
            assert r.lev == (None if None in (t, seed) else _lev_np(tok(seed), tok(t)))
            assert r.tree_lines == (None if None in (t, seed) else max(seed.count("\n"), t.count("\n")) + 1)
            assert r.first == (place == [k for k, _ in cands].index(j))
            if r.first:
                others = [sum(len(tok(x)) for x in by[k]) for k in by if k != j]
                size = sum(len(tok(x)) for x in by[j])
                assert (r.hyp_len, r.ref_len) == (size, len(tok(gold)))
                assert r.near_len == min(((abs(x - size), x) for x in others), default=(0, None))[1]
                for n in range(1, 5):
                    mine, rest = counts(by[j], n), [counts(by[k], n) for k in by if k != j]
                    assert r[f"num{n}"] == sum(min(c, counts([gold], n)[g]) for g, c in mine.items())
                    assert r[f"own{n}"] == sum(min(c, max((x[g] for x in rest), default=0)) for g, c in mine.items())


def test_pairs_with_their_candidates_leave_by_their_numbers(spark):
    from flipframe.plans import suite as SU

    # ids 0 and 1 name two rows each and so have twice the candidates
    rows = [(k // 2 if k < 4 else k, "a b", "a b c", 1, [(j, "a b " * (k % 3 + 1)) for j in range(3)]) for k in range(9)]
    schema = "paired_id long, example string, counterfactual string, label_counter int, cands array<struct<idx:int,generated:string>>"
    got = {r.metric: r.value for r in SU.evaluate_lists(spark.createDataFrame(rows, schema), 3, "bd", calculate_corr=False).collect()}
    assert got["n_removed"] == 4.0
    assert got["avg_len_counter"] == 3.0 and abs(got["avg_len_generated_counter"] - sum(2 * (k % 3 + 1) for k in range(4, 9)) / 5) < 1e-9


def test_tree_pairs_are_dealt_to_many_tasks(spark):
    from flipframe.operators import distance as D
    from flipframe.session import shuffle_partitions

    df = spark.range(200).select(F.col("id").alias("paired_id"), F.lit(0).alias("idx"), F.array(F.concat(F.lit("(D (S (T a"), "id", F.lit(")))"))).alias("ref_trees"),
                                 F.array(F.lit("(D (S (T b)))")).alias("gen_trees"))
    out = D.tree_distance_rows(df)
    assert {r.tree_distance for r in out.collect()} == {1.0}
    assert f"{4 * shuffle_partitions(spark)}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
