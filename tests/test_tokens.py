import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flipframe.functions.text import line_tokens
from flipframe.operators import models as MD
from flipframe.operators import scores as S
from flipframe.operators.tokens import char_classes, cut_texts

ODD = "a b_9\n\t\r\x0b\x0c\x1c\x85\xa0é́ß.,!-²½Ⅷ١中文、\u2028\u3000\ufeff\ufffd😀𝒳𐐷\U000e0001\0"


def lines_of(texts, classes):
    n_lines, sizes, tokens = cut_texts(pa.array(texts, pa.string()), classes)
    flat, sizes, out = iter(tokens.to_pylist()), iter(sizes.tolist()), []
    for t, n in zip(texts, n_lines.tolist()):
        out.append([[next(flat) for _ in range(next(sizes))] for _ in range(n)] if t is not None else None)
        assert t is not None or n == 0
    assert next(flat, None) is None and next(sizes, None) is None
    return out


@pytest.mark.parametrize("alphabet", ["ab. \n_9", ODD])
def test_texts_are_cut_as_the_jvm_cuts_them(spark, alphabet):
    rnd = random.Random(7)
    texts = [None, "", "\n", "a", "", "a\n", *["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(400)], None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", line_tokens("text").alias("t")).collect()
    want = [r.t for r in sorted(rows, key=lambda r: r.k)]
    classes = np.frombuffer(char_classes(spark), np.uint8)
    assert lines_of(texts, classes) == want
    assert lines_of([], classes) == [] and lines_of([None], classes) == [None] and lines_of([""], classes) == [[[]]]


def test_every_code_point_is_classed_as_the_jvm_classes_it(spark):
    classes = np.frombuffer(char_classes(spark), np.uint8)
    picked = [*range(0x300), *range(0xD700, 0xD800), *range(0xE000, 0xE100), *range(0x2000, 0x2100), *range(0xFFF0, 0x10010), 0x10FFFF]
    texts = [chr(c) * 2 for c in picked]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.size(line_tokens("text")[0]).alias("n")).collect()
    got = {r.k: r.n for r in rows if texts[r.k] != "\n\n"}
    assert all(classes[picked[k]] == {0: 0, 1: 1, 2: 2}[n] for k, n in got.items())
    assert len(classes) == 0x110000 and not classes[0xD800:0xE000].any()


def test_scoring_a_pair_tokenises_no_text_in_the_plan(spark):
    """The sides of a pair were cut by regular expression for each of its rows."""
    from flipframe.plans import suite as SU

    plans = []
    schema = ("rid long, task string, original_prem string, counter_prem string, original_hyp string, counter_hyp string, counter_label string, "
              "cands array<struct<idx:int,generated:string>>")
    rows = [(1, "RP", "a b", "a c", "d e f", None, "x", [(0, "b a"), (1, "a b c")]), (2, "RH", "a b", None, "d e", "f", "y", [(0, "e d"), (1, "e")])]
    old, SU.scratch_table = SU.scratch_table, lambda df, name: plans.append(df) or df
    try:
        got = {r.metric: r.value for r in SU.evaluate_nli(spark.createDataFrame(rows, schema), None, 2, {"x": 2, "y": 1}, "gc", line_trees=True, calculate_corr=False).collect()}
    finally:
        SU.scratch_table = old
    # (candidate + other side) % 3: 2 + 3, 3 + 3; 2 + 2, 1 + 2
    assert got["label_flip"] == pytest.approx((1 + 0 + 1 + 0) / 4)
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "regexp_extract_all" not in above and "regexp_extract_all" in plan
    assert S.candidate_scores and MD.nli_rule_scorer.on_counts is MD.joint_count_class
