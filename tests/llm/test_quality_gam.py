import zlib

import numpy as np
from helpers import AWKWARD, docs_of, sf

from flipframe.llm import quality_gam as Q


def test_held_out_accuracy_and_fold(spark):
    docs, labels = sf(spark, "documents", "/root/testdata/sf0.1"), sf(spark, "labels", "/root/testdata/sf0.1")
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    y = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(y) > 300 and np.mean([a == b for a, b in y]) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = sf(spark, "documents"), sf(spark, "labels")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, Q.quality_scores(docs, labels).collect()))
    assert a == sorted(map(tuple, Q.quality_scores(docs, flipped).collect()))


def test_pair_tables_learn_an_interaction():
    r = np.random.default_rng(1)
    x = np.zeros((4000, len(Q.FEATURES)))
    x[:, :2] = r.random((4000, 2))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    m = Q.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95
    alone = Q.fit(x, y, max_pairs=0)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.7


def test_score_is_the_sum_of_its_tables():
    r = np.random.default_rng(2)
    x = r.random((500, len(Q.FEATURES)))
    m = Q.fit(x, x[:, 3] > 0.4)
    row = x[7]
    z = m.base + sum(t[(e <= v).sum()] for e, t, v in zip(m.edges, m.tables, row))
    z += sum(t[(m.pair_edges[a] <= row[a]).sum(), (m.pair_edges[b] <= row[b]).sum()] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(x)[7] - 1 / (1 + np.exp(-z))) < 1e-12


def test_awkward_rows_empty_tables_and_one_class(spark):
    docs = docs_of(spark, [*AWKWARD, "null id"], [*range(len(AWKWARD)), None])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert Q.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert len({r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()}) == 1
    kept = Q.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
