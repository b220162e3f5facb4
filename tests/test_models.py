import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flipframe.functions import templates as TP
from flipframe.operators import candidates as C
from flipframe.operators import models as MD


def test_template_without_special_tokens(spark):
    df = spark.createDataFrame([(0, "Bad plot", 1, "Good plot")], "label_ex int, example string, label_counter int, counterfactual string")
    got = df.select(TP.wrap_sentiment(TP.SENTIMENT_TEMPLATES["1"], spec_tokens="None")).first()[0]
    assert got == "<bos_token>Negative review:<sep>Bad plot<sep>Positive review:<sep>Good plot<eos_token>"


def test_first_flip_two_pass_scores_only_failures(spark):
    rows = [(0, 0, "a", 1, 1), (1, 0, "b", 0, 1)]
    first = spark.createDataFrame(rows, "paired_id long, idx int, generated string, pred int, target int")
    seen = {}

    def score_rest(ids):
        seen["ids"] = sorted(r.paired_id for r in ids.collect())
        rest = spark.createDataFrame([(1, 1, "b1", 1, 1), (1, 2, "b2", 1, 1)],
                                     "paired_id long, idx int, generated string, pred int, target int")
        return rest.join(ids, "paired_id", "left_semi")

    got = {r.paired_id: (r.chosen_idx, r.labels) for r in C.first_flip_two_pass(first, score_rest, "paired_id", 3).collect()}
    assert seen["ids"] == [1]
    assert got == {0: (0, 1), 1: (1, 1)}


def test_model_scorer_through_predict_batch_udf(spark):
    def make_predict_fn():
        def predict(texts: np.ndarray):
            lens = np.array([len(t) for t in texts])
            return {"label": (lens % 2).astype(np.int32), "score": lens / 1000.0}

        return predict

    df = spark.createDataFrame([("abc",), ("abcd",), ("x" * 600,)], "text string")
    got = MD.score_texts_udf(df, "text", make_predict_fn, batch_size=2).collect()
    assert [(r.pred, r.score) for r in got] == [(1, 0.003), (0, 0.004), (1, 0.511)]


def test_generator_failure_gives_nulls(spark):
    def gen(pdf: pd.DataFrame, n: int):
        if (pdf["example"] == "boom").any():
            raise RuntimeError("bad row")
        return [[f"{e}-{i}" for i in range(n)] for e in pdf["example"]]

    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "paired_id long, example string").repartition(1)
    out = {r.paired_id: (r.generated, r.error) for r in MD.generate_candidates(df, gen, 2, ["paired_id"]).collect()}
    assert out[1] == (["ok-0", "ok-1"], None)
    assert out[2][0] == [None, None] and "bad row" in out[2][1]


def test_a_generator_holds_a_slice_of_a_batch(spark):
    """An Arrow batch has up to 10,000 rows; the generator gets them in bounded runs, a long row on its own."""
    def generate(pdf, n):
        size = sum(len(p) + len(e) for p, e in zip(pdf["prompt"], pdf["example"]))
        if len(pdf) > 1 and (len(pdf) > MD.SLICE_ROWS or size > MD.SLICE_BYTES):
            raise ValueError("too much at once")
        return [[f"{len(pdf)} {e[:9]}"] * n for e in pdf["example"]]

    rows = spark.range(0, 3000, 1, 1).select("id", F.lit("p").alias("prompt"), F.concat(F.col("id").cast("string"), F.repeat(
        F.lit(" x"), F.when(F.col("id") == 700, MD.SLICE_BYTES).otherwise(F.when(F.col("id") > 2900, 100_000).otherwise(5)).cast("int"))).alias("example"), F.lit(9).alias("max_length"))
    got = MD.generate_candidates(rows, generate, 2, ["id"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(3000)) and all(r.error is None and len(r.generated) == 2 for r in got)
    assert all(r.generated[0].split()[1] == str(r.id) for r in got)
    sizes = {int(r.generated[0].split()[0]) for r in got}
    assert max(sizes) == MD.SLICE_ROWS and 1 in sizes
