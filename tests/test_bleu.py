import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens
from flipframe.operators import ngram


def py_bleu(refs, hyps, weights=(0.25,) * 4):
    """Small pure-Python model of smoothed corpus BLEU (second oracle)."""
    num, den = [0] * 4, [0] * 4
    H = R = 0
    for r, h in zip(refs, hyps):
        H += len(h)
        R += len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            num[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            den[n - 1] += max(1, len(h) - n + 1)
    if num[0] == 0:
        return 0.0
    p = [(x if x > 0 else 0.1) / d for x, d in zip(num, den)]
    bp = 1.0 if H > R else (0.0 if H == 0 else math.exp(1 - R / H))
    return bp * math.exp(sum(w * math.log(q) for w, q in zip(weights, p) if w))


def _match(spark, rows):
    df = spark.createDataFrame(rows, "id long, idx int, hyp string, ref string")
    hyp = df.select("id", "idx", word_tokens("hyp").alias("hyp_tokens"))
    ref = df.select("id", word_tokens("ref").alias("ref_tokens")).dropDuplicates(["id"])
    return ngram.match_table(hyp, ref)


def test_sentence_bleu_golden(spark):
    rows = [(1, 0, "the cat sat on", "the big cat on"), (2, 0, "good film", "good film"),
            (3, 0, "the cat", "the cat sat on"), (4, 0, "x y", "a b"), (5, 0, "a b c d e", "a b c d e")]
    got = {r.id: r.s for r in _match(spark, rows).select("id", ngram.sentence_bleu_col().alias("s")).collect()}
    assert got[1] == pytest.approx(0.10573712634405641, abs=1e-12)
    assert got[2] == pytest.approx(0.31622776601683794, abs=1e-12)
    assert got[3] == pytest.approx(0.11633369384516798, abs=1e-12)
    assert got[4] == 0.0
    assert got[5] == pytest.approx(1.0)


def test_bleu_at_n_golden(spark):
    m = _match(spark, [(1, 0, "the cat sat on", "the big cat on")])
    r = m.select(ngram.sentence_bleu_col(ngram.ONE_HOT_WEIGHTS[1]).alias("b1"),
                 ngram.sentence_bleu_col(ngram.ONE_HOT_WEIGHTS[2]).alias("b2")).first()
    assert r.b1 == pytest.approx(0.75)
    assert r.b2 == pytest.approx(0.1 / 3)


def test_corpus_bleu_per_row_floor(spark):
    m = _match(spark, [(1, 0, "the cat sat on", "the big cat on"), (2, 0, "good film", "good film")])
    r = ngram.corpus_bleu_by_idx(m).first()
    assert r.bleu == pytest.approx(0.13650604313545336, abs=1e-12)


def test_self_bleu_golden(spark):
    c = spark.createDataFrame([(1, 0, "a b c d e"), (1, 1, "a b c d f"), (1, 2, "x y z w v")], "id long, idx int, t string")
    toks = c.select("id", "idx", word_tokens("t").alias("tokens"))
    rows = ngram.self_bleu_rows(toks).collect()
    assert rows[0].self_bleu == pytest.approx(0.44582686998428134, abs=1e-12)


words = st.lists(st.sampled_from(list("abcde")), min_size=0, max_size=9)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=4))
def test_bleu_matches_python_model(spark, pairs):
    rows = [(i, 0, " ".join(h), " ".join(r)) for i, (h, r) in enumerate(pairs)]
    m = _match(spark, rows)
    got = ngram.corpus_bleu_by_idx(m).first().bleu
    assert got == pytest.approx(py_bleu([r for _, r in pairs], [h for h, _ in pairs]), abs=1e-9)


def test_bleu_and_distance_unchanged_under_repartition(spark):
    import random

    from flipframe.operators import distance as D

    rnd = random.Random(11)
    rows = []
    for i in range(30):
        ref = " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12)))
        for j in range(3):
            rows.append((i, j, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))), ref))
    df = spark.createDataFrame(rows, "id long, idx int, hyp string, ref string")

    def run(parts):
        d = df.repartition(parts)
        hyp = d.select("id", "idx", word_tokens("hyp").alias("hyp_tokens"))
        ref = d.select("id", word_tokens("ref").alias("ref_tokens")).dropDuplicates(["id"])
        m = ngram.match_table(hyp, ref).select("id", "idx", ngram.sentence_bleu_col().alias("s"))
        dist = D.with_token_edit_distance(d.select("id", "idx", word_tokens("hyp").alias("a"), word_tokens("ref").alias("b")), "a", "b")
        return (sorted((r.id, r.idx, round(r.s, 12)) for r in m.collect()),
                sorted((r.id, r.idx, r.distance) for r in dist.collect()))

    assert run(1) == run(7)


def test_suite_without_correlations_lists_null_metrics(spark):
    from flipframe.plans import suite

    pairs = spark.createDataFrame([(1, "a b c", 0, "x y z", 1), (2, "d e", 1, "u v", 0)],
                                  "paired_id long, example string, label_ex int, counterfactual string, label_counter int")
    cands = spark.createDataFrame([(1, 0, "x y"), (1, 1, "x z"), (2, 0, "u"), (2, 1, "v u")], "paired_id long, idx int, generated string")
    got = {r.metric: r.value for r in suite.evaluate(pairs, cands, 2, metrics="bd", calculate_corr=False).collect()}
    assert got["sent_bleu_pearson"] is None and got["self_bleu_spearman"] is None
    assert got["n_removed"] == 0.0 and got["corpus_bleu"] >= 0.0
