import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flipframe.operators import kneser as KN

WORDS = re.compile(r"\w+|[^\w\s]")
TRAIN = ["the cat sat on the mat", "the cat ran", "a dog sat on a log .", "the dog ran on", "", None, "the the the cat", "a b c d e f"]
HELD = [(1, "the cat sat"), (2, "a zebra ran on the log"), (3, ""), (4, "the cat the cat"), (5, None), (6, "zz yy")]


def padded(t, n):
    return ["<s>"] * (n - 1) + WORDS.findall(t) + ["</s>"]


def brute(order):
    counts = {order: Counter()}
    for t in TRAIN:
        if t is not None:
            p = padded(t, order)
            counts[order].update(tuple(p[i : i + order]) for i in range(len(p) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k, c in counts.items():
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        disc[k] = one / (one + 2 * two) if one else KN.DISCOUNT
        ctx[k] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            ctx[k][g[:-1]][0] += v
            ctx[k][g[:-1]][1] += 1

    def prob(g):
        k = len(g)
        below = 1 / (ctx[1][()][1] + 1) if k == 1 else prob(g[1:])
        total, types = ctx[k].get(g[:-1], (0, 0))
        return below if not total else max(counts[k][g] - disc[k], 0) / total + disc[k] * types / total * below

    return prob, counts


@pytest.mark.parametrize("order", [1, 2, 4])
def test_losses_equal_the_recursion(spark, order):
    model = KN.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"), order=order)
    got = KN.token_losses(model, spark.createDataFrame(HELD, "item long, text string"), "item")
    per = {r.item: (r.n, r.loss) for r in got.groupBy("item").agg({"n": "sum", "nll": "max"}).toDF("item", "n", "loss").collect()}
    prob, counts = brute(order)
    for item, text in HELD:
        if text is None:
            assert item not in per
            continue
        p = padded(text, order)
        want = [-math.log(prob(tuple(p[i : i + order]))) for i in range(len(p) - order + 1)]
        assert per[item][0] == len(want) and per[item][1] == pytest.approx(max(want), abs=1e-12)


@pytest.mark.parametrize("order, size", [(3, None), (4, 0), (5, None)])
def test_higher_orders_are_written_only_near_the_held_out_texts(spark, monkeypatch, order, size):
    """Above pairs, no gram is written whose context no held-out text has; the losses are those of the whole model, with the
    cuts broadcast or not."""
    written = []

    def scratch(df, name):
        written.append(df)
        return df.localCheckpoint()

    monkeypatch.setattr(KN, "scratch_table", scratch)
    if size is not None:
        monkeypatch.setattr(KN, "BROADCAST_BYTES", size)
    model = KN.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"), order=order)
    got = KN.token_losses(model, spark.createDataFrame(HELD, "item long, text string"), "item")
    per = {r.item: r for r in got.groupBy("item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("nll")).alias("nll")).collect()}
    prob, counts = brute(order)
    items = {i: padded(t, order) for i, t in HELD if t is not None}
    assert set(per) == set(items)
    for item, p in items.items():
        want = [-math.log(prob(tuple(p[i : i + order]))) for i in range(len(p) - order + 1)]
        assert per[item].n == len(want) and per[item].nll == pytest.approx(sum(want), abs=1e-9)
    met = {tuple(p[i - 1 : i + 1]) for p in items.values() for i in range(order - 2, len(p) - 1)}
    long = [g for df in written if "gram" in df.columns and "item" not in df.columns for (w,) in df.select("gram").collect() if len(g := w.split(" ")) > 2]
    assert any(tuple(g) in counts[order] for g in long)
    assert all(tuple(g[-3:-1]) in met for g in long)


def test_probabilities_sum_to_one():
    prob, counts = brute(3)
    vocab = [g[0] for g in counts[1]] + ["never seen"]
    for ctx in (("<s>", "<s>"), ("the", "cat"), ("x", "y"), ("on", "the")):
        assert sum(prob((*ctx, w)) for w in vocab) == pytest.approx(1.0)
