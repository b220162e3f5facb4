import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["metric", "value"]


def test_every_query_registered_with_oracle_or_rows_check():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_small_query_matches_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    for name in ("bleu_corpus", "first_flip", "kfold_val", "nli_first_match_rp"):
        a = sorted(tuple(r) for r in E.queries()[name](spark, d).collect())
        b = sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(E.queries()[name](spark, d).columns)} FROM ({E.oracle_sql()[name]})").fetchall())
        assert a == b, name
