import math
from collections import Counter, defaultdict

from flipframe.operators import bayes as BY


def brute(train, texts, s):
    words, docs = defaultdict(Counter), Counter()
    for t, y in train:
        words[y].update(t.split())
        docs[y] += 1
    v = len({w for c in words.values() for w in c})
    out = {}
    for i, t in texts:
        score = {}
        for y, c in words.items():
            total = sum(c.values())
            score[y] = (math.log(docs[y] / len(train)) if s["prior"] else 0.0) + sum(math.log((c[w] + s["alpha"]) / (total + s["alpha"] * v)) for w in t.split())
        out[i] = min(y for y in score if score[y] >= max(score.values()) - 1e-12)
    return out


def test_predictions_and_sweep_equal_brute_force(spark):
    import random

    rnd = random.Random(2)
    line = lambda y: " ".join(rnd.choice("abcdef" if y else "defghi") for _ in range(rnd.randint(0, 8)))
    rows = [(i, line(i % 3 == 0), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    train, val = df.filter("doc_id < 120"), df.filter("doc_id >= 120")
    grid = BY.settings_grid([0.1, 1.0, 5.0], [True, False])
    pred = {(r.setting, r.doc_id): r.pred for r in BY.predict(BY.train_counts(train), val, grid, "doc_id").collect()}
    acc = {}
    for s in grid:
        want = brute([(t, y) for i, t, y in rows if i < 120], [(i, t) for i, t, _ in rows if i >= 120], s)
        assert {i: pred[s["setting"], i] for i in want} == want
        acc[s["setting"]] = sum(want[i] == y for i, _, y in rows if i >= 120) / 80
    got = BY.sweep(train, val, grid, "doc_id").collect()
    assert {r.setting: r.accuracy for r in got} == acc
    assert [r.setting for r in got if r.best] == [min(k for k, a in acc.items() if a == max(acc.values()))]


def test_random_settings_are_a_fixed_subset():
    grid = BY.settings_grid([0.1, 1.0, 5.0, 10.0])
    assert BY.random_settings(grid, 2, 7) == BY.random_settings(grid, 2, 7)
    assert len(BY.random_settings(grid, 2, 7)) == 2 and all(s in grid for s in BY.random_settings(grid, 9, 1))
