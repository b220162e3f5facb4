import pytest
from pyspark.sql import functions as F

from flipframe.operators import candidates as C
from flipframe.operators import metrics as M


def test_mcnemar_goldens(spark):
    t = spark.createDataFrame([(55, 5, 15, 25)], "cc long, ci long, ic long, ii long")
    r = M.mcnemar(t).first()
    assert r.p_exact == pytest.approx(0.04138946533203125, abs=1e-12)
    assert r.chi2 == pytest.approx(4.05)
    assert r.p_chi2 == pytest.approx(0.04417134490844261, abs=1e-12)
    assert r.significant_05 is True and r.significant_01 is False


def test_crosstab_margins(spark):
    rows = [("T", "T")] * 55 + [("T", "M")] * 5 + [("M", "T")] * 15 + [("M", "M")] * 25
    df = spark.createDataFrame(rows, "before string, after string")
    got = {(r.before, r.after): r.n for r in M.crosstab_margins(df, "before", "after").collect()}
    assert got[("T", None)] == 60 and got[("M", None)] == 40
    assert got[(None, "T")] == 70 and got[(None, "M")] == 30
    assert got[(None, None)] == 100


def test_two_level_variance_of_variances(spark):
    # candidate 0 rows have variance 0.1, candidate 1 rows variance 0.3 -> reported var 0.01
    import math

    a, b = math.sqrt(0.1), math.sqrt(0.3)
    rows = [(0, 1 + a), (0, 1 - a), (1, 1 + b), (1, 1 - b)]
    df = spark.createDataFrame(rows, "idx int, s double")
    r = M.two_level_mean_var(df, "s").first()
    assert r.var == pytest.approx(0.01)
    one = M.two_level_mean_var(df.filter("idx = 0"), "s").first()
    assert one.var == 0.0


def test_first_flip_fixture(spark):
    rows = []
    for pid, preds in enumerate([[0, 1, 1], [0, 0, 0], [1, 0, 0]]):
        rows += [(pid, i, f"t{pid}{i}", p, 1) for i, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "paired_id long, idx int, generated string, pred int, target int")
    got = {r.paired_id: (r.chosen_idx, r.labels) for r in C.first_flip(df, "paired_id", 3).collect()}
    assert got == {0: (1, 1), 1: (0, 0), 2: (0, 1)}


def test_spearman_ties(spark):
    rows = [(0, 1.0, 1), (0, 2.0, 2), (0, 2.0, 3), (0, 3.0, 3), (0, 4.0, 5)]
    df = spark.createDataFrame(rows, "idx int, x double, y long")
    r = M.spearman_by(df, "x", "y").first()
    # scipy.stats.spearmanr on these values
    import numpy as np

    def mid(v):
        order = sorted(v)
        return [sum(i + 1 for i, w in enumerate(order) if w == x) / order.count(x) for x in v]

    expect = np.corrcoef(mid([1, 2, 2, 3, 4]), mid([1, 2, 3, 3, 5]))[0, 1]
    assert r.spearman == pytest.approx(expect)


def test_binary_prf_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    r = M.binary_prf(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


def test_cat_assemble_keeps_generated_rows(spark):
    orig = spark.createDataFrame([("good", 1, 7)], "text string, labels int, index long")
    gen = spark.createDataFrame([("bad", 0)], "generated string, label_counter int")
    out = C.cat_assemble(orig, gen).na.drop()
    assert out.count() == 2
