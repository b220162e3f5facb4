import corpus_pipeline as P
from helpers import docs_of, sf
from test_covering_simhash import brute_components, brute_fp
from test_wu_manber import brute as brute_windows

from flipframe.llm import quality_gam as Q

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = sf(spark, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "encode"]
    scored = {r.doc_id: r.predicted for r in Q.quality_scores(docs, sf(spark, "labels")).collect()}
    a = P.quality(spark, docs, SF)
    rows = {r.doc_id: r.text for r in a.collect()}
    assert a.columns == docs.columns and set(rows) == {i for i, p in scored.items() if p}
    b = P.near_dedup(spark, a, SF)
    ids = [r.doc_id for r in b.collect()]
    assert b.columns == docs.columns and sorted(ids) == sorted({c for _, _, c in brute_components([(i, brute_fp(t)) for i, t in rows.items()])})
    c = P.decontaminate(spark, b, SF)
    bench = [(r.item_id, r.text) for r in sf(spark, "benchmark").collect()]
    clean = {r[0] for r in brute_windows([(i, rows[i]) for i in ids], bench) if not r[5]}
    assert c.columns == docs.columns and {r.doc_id for r in c.collect()} == clean
    out = P.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == clean


def test_stages_on_empty_and_awkward_documents(spark):
    docs = docs_of(spark, [None, "", "x"], extra=False)
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in P.STAGES:
            out = stage(spark, out, SF)
        assert out.count() <= 3


def test_stages_with_clashing_columns_ties_and_repeated_ids(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = docs_of(spark, [long, long, long + " end", "other text here", None, long], [5, 5, 3, 7, 7, 9])
    kept = P.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.text and r.text.startswith("word0")) in ([3], [3, 5])
    clean = P.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    good = P.quality(spark, docs, SF)
    assert good.columns == docs.columns and good.count() <= docs.count()
