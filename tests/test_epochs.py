import math
import re
from collections import Counter, defaultdict

import pytest

from flipframe.operators import epochs as E

WORDS = re.compile(r"\w+|[^\w\s]")


def features(text):
    c = Counter(WORDS.findall(text or ""))
    x = {w: 1 + math.log(n) for w, n in c.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {"": 1.0, **{w: v / norm for w, v in x.items()}}


def brute(train, val, s, batch_of):
    labels = sorted({y for _, _, y in train if y is not None})
    tr = [(i, features(t), y) for i, t, y in train if y is not None]
    va = [(features(t), y) for _, t, y in val]
    w, m, v = (defaultdict(lambda: [0.0] * len(labels)) for _ in range(3))

    def scores(f):
        return [sum(x * w[k][c] for k, x in f.items()) for c in range(len(labels))]

    def probs(f):
        e = [math.exp(z - max(scores(f))) for z in scores(f)]
        return [z / sum(e) for z in e]

    out, step = [], 0
    for epoch in range(1, s.max_epochs + 1):
        loss = sum(-math.log(probs(f)[labels.index(y)]) for _, f, y in tr) / len(tr)
        for b in range(s.batches):
            step += 1
            part = [r for r in tr if batch_of(r[0]) == b]
            g = defaultdict(lambda: [0.0] * len(labels))
            for _, f, y in part:
                p = probs(f)
                for k, x in f.items():
                    for c in range(len(labels)):
                        g[k][c] += x * (p[c] - (labels[c] == y)) / len(part)
            for k in {*w, *g}:
                for c in range(len(labels)):
                    m[k][c] = E.BETA1 * m[k][c] + (1 - E.BETA1) * g[k][c]
                    v[k][c] = E.BETA2 * v[k][c] + (1 - E.BETA2) * g[k][c] ** 2
                    move = (m[k][c] / (1 - E.BETA1**step)) / (math.sqrt(v[k][c] / (1 - E.BETA2**step)) + s.epsilon)
                    w[k][c] -= s.rate * (move + s.decay * w[k][c])
        hits = [labels[max(range(len(labels)), key=lambda c: (scores(f)[c], -c))] == y for f, y in va]
        out.append((epoch, loss, sum(hits) / len(hits)))
        best = max(out, key=lambda e: (e[2], -e[0]))[0]
        if epoch - best >= s.patience:
            break
    return out, best


def data(n):
    pools = {0: "bad dull awful the a plot", 1: "good fine great the a plot", 3: "meh so the a plot ok"}
    rows = []
    for i in range(n):
        y = (0, 1, 3)[i % 3]
        words = pools[y].split()
        rows.append((i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1, 3 + i % 7)), y))
    return [*rows, (n, None, 1), (n + 1, "", 0), (n + 2, "unlabelled good", None), (n + 3, "Noise! " * 50, 3)]


def frames(spark, train, val):
    make = lambda rows: E.document_features(spark.createDataFrame(rows, "id long, text string, labels int"), "id")
    return make(train), make(val)


@pytest.mark.parametrize("s", [E.Settings(rate=0.3, decay=0.1, max_epochs=3, patience=3, batches=2), E.Settings(rate=0.5, max_epochs=4, patience=1)])
def test_every_epoch_equals_brute_force(spark, s):
    from pyspark.sql import functions as F

    train, val = data(40), data(23)
    bucket = {r.id: r.b for r in spark.range(60).select("id", F.pmod(F.xxhash64(F.lit("epochs"), "id"), F.lit(s.batches)).alias("b")).collect()}
    want, best = brute(train, [r for r in val if r[2] is not None], s, bucket.get)
    f, v = frames(spark, train, [r for r in val if r[2] is not None])
    weights, got, labels = E.train(f, v, s)
    assert labels == [0, 1, 3] and [e["epoch"] for e in got] == [e[0] for e in want]
    for g, (_, loss, acc) in zip(got, want):
        assert g["loss"] == pytest.approx(loss, abs=1e-9) and g["accuracy"] == acc
    assert [e["epoch"] for e in got if e["best"]] == [best]
    hits = E.predict(weights, labels, v).join(v, "id").where("pred = label").count()
    assert hits / v.count() == want[best - 1][2]


def test_empty_sets(spark):
    f, v = frames(spark, [], data(4)[:4])
    weights, epochs, labels = E.train(f, v, E.Settings(max_epochs=2))
    assert (weights.count(), epochs, labels) == (0, [], [])


def test_features_are_shuffled_before_the_passes_only(spark):
    """A pass joins and sums the bucketed features where they lie; only weights, residuals and partial sums are exchanged."""
    from pyspark.sql import functions as F

    f, _ = frames(spark, data(40), data(4))
    lots = E._Lots(f)
    weights = spark.createDataFrame([("good", [0.5, -0.5, 0.0])], "feature string, w array<double>")
    with E._joined_in_lots(spark):
        scores = lots.scores(weights, [0, 1, 3], F.lit(True))
        plain = {r.id: tuple(r.scores) for r in E.class_scores(f, weights, [0, 1, 3]).collect()}
        assert {r.id: tuple(r.scores) for r in scores.collect()} == plain
        grad = lots.gradient(scores.select("lot", "id", F.col("scores").alias("r")), 3)
        for df in (scores, grad):
            plan = df._jdf.queryExecution().executedPlan().toString()
            plan = plan.split("== Initial Plan ==")[-1]
            lines = plan.splitlines()
            for k, line in enumerate(lines):
                if "FileScan" in line and "entries_" in line:
                    depth = line.index("FileScan")
                    above = []
                    for up in reversed(lines[:k]):
                        at = len(up) - len(up.lstrip(" :+-*"))
                        if at < depth:
                            above.append(up)
                            depth = at
                        if "Join" in up and at <= depth:
                            break
                    assert not any("Exchange" in up for up in above), plan
