import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flipframe.functions import tails as TA
from flipframe.operators import metrics as M


def test_erfc(spark):
    zs = [0.0, 1e-9, 0.1, 0.9, 1.5, 2.4999, 2.5, 2.6, 3.0, 5.0, 10.0, 20.0]
    got = {r.z: r.e for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", TA.erfc(F.col("z")).alias("e")).collect()}
    for z in zs:
        assert got[z] == pytest.approx(math.erfc(z), rel=1e-11)


def test_exact_sign_test(spark):
    def exact(b, c):
        n, k = b + c, min(b, c)
        total = sum(math.comb(n, i) for i in range(k + 1))
        p = min(Fraction(1), Fraction(2 * total, 2**n))
        return (math.log(p.numerator) - math.log(p.denominator)) / math.log(10)

    pairs = [(0, 0), (0, 1), (1, 1), (3, 3), (5, 15), (15, 5), (0, 40), (7, 16), (16, 17), (100, 160), (900, 1000), (5000, 5200), (10, 3000)]
    df = spark.createDataFrame(pairs, "b long, c long").select("b", "c", TA.binomial_half_log10_two_sided(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(exact(r.b, r.c), abs=1e-9), (r.b, r.c)
    # one standard deviation and a half of a billion tosses, by the normal law
    half, off = 500_000_000, 31_623 * 3 // 4
    r = spark.createDataFrame([(half - off, half + off)], "b long, c long").select(TA.binomial_half_log10_two_sided(F.col("b"), F.col("c"))).first()[0]
    assert r == pytest.approx(math.log10(math.erfc((off - 0.5) / math.sqrt(1e9) * math.sqrt(2))), abs=1e-6)


def test_mcnemar_needs_no_python_worker(spark):
    t = spark.createDataFrame([(55, 5, 15, 25)], "cc long, ci long, ic long, ii long")
    plan = M.mcnemar(t)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "EvalPython" not in plan
