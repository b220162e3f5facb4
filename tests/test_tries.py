from collections import Counter

import pyarrow as pa
import pytest

from flipframe.operators import kneser as KN
from flipframe.operators import tries as TR

TEXTS = [["the", "cat", "sat"], [], ["the", "cat", "ran"], ["a", "b"] * 9, ["the", "cat", "sat"], ["x"], *[["of", "the", f"w{k}", "of", "the"] for k in range(40)]]


def brute(order):
    counts = {order: Counter()}
    for t in TEXTS:
        p = ["<s>"] * (order - 1) + t + ["</s>"]
        counts[order].update(tuple(p[i : i + order]) for i in range(len(p) - order + 1))
    for k in range(order - 1, 1, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


@pytest.mark.parametrize("order", [3, 4, 5])
@pytest.mark.parametrize("lot, grams, listed", [(1 << 20, 1 << 20, ["the", "of", "cat"]), (7, 1 << 20, []), (7, 5, ["the", "never met"])])
def test_packed_parts_hold_the_counts_of_every_gram(monkeypatch, order, lot, grams, listed):
    """Whatever the lots, the words that are listed, and the slices in which a part is unpacked."""
    monkeypatch.setattr(TR, "LOT_TOKENS", lot)
    monkeypatch.setattr(TR, "SLICE_GRAMS", grams)
    names = pa.array(["<s>", "</s>", *listed])
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], names=["t"]) for t in (TEXTS[:5], [], TEXTS[5:])]
    blobs = [b for lens, tokens in TR._lots(iter(batches)) for b in TR._blobs(lens, tokens, order, 3, names)]
    assert lot > 7 or len(blobs) > 30
    pairs, tally = Counter(), Counter()
    for part in range(3):
        own = [(n, b) for p, n, b in blobs if p == part]
        for batch in TR._counted([b for _, b in own], sum(n for n, _ in own), order, names):
            for row in batch.to_pylist():
                assert row["gram"] not in pairs
                pairs[row.pop("gram")] = row.pop("c")
                tally.update(row)
    want = brute(order)
    assert pairs == {" ".join(g): c for g, c in want[2].items()}
    assert tally == {f"{name}{k}": sum(c == n for c in want[k].values()) for k in range(3, order + 1) for name, n in (("one", 1), ("two", 2))}


def test_grams_above_pairs_are_not_shuffled_as_rows(spark, monkeypatch):
    """Their disk was the sum of three shuffles of strings."""
    plans = []

    def scratch(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(KN, "scratch_table", scratch)
    KN.train(spark.createDataFrame([(" ".join(t),) for t in TEXTS], "text string"), order=4)
    assert "hashpartitioning(gram" not in plans[0] and plans[0].count("Exchange") <= 2  # the texts dealt to the cores, and the parts


def test_frequent_words_are_listed_by_a_count_that_bounds_them(spark, monkeypatch):
    texts = spark.createDataFrame([("a a a a b b b c c d d e",)], "t string")
    words = KN.word_tokens("t")
    assert TR._frequent(texts, words) == ["a", "b", "c", "d"]
    monkeypatch.setattr(TR, "LISTED", 3)
    assert TR._frequent(texts, words) == ["a", "b"]  # a third would need one of two equals
    assert TR._frequent(texts.where("t is null"), words) == []


def test_shuffles_dropped_restores_the_setting(spark):
    from flipframe.session import shuffles_dropped

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
