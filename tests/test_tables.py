from pyspark.sql import functions as F
import pytest

from flipframe.plans import tables as TB


def test_turns_beyond_2_20_keep_their_own_pairs(spark, tmp_path):
    far = TB.TURNS
    rows = []
    for conv, first in ((7, far), (8, 0), (7, 0), (8, far), (0, 3 * far), (2, far)):
        for k in range(5):
            rows.append((conv, first + k, "user" if k % 2 == 0 else "assistant", f"c{conv} t{first + k}"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs, cands = TB.conversation_pairs(spark, str(tmp_path))
    assert pairs.columns == ["paired_id", "example", "label_ex", "counterfactual", "label_counter", "cf_turn"]
    got = pairs.collect()
    assert len(got) == 12 and len({r.paired_id for r in got}) == 12
    by_id = {r.paired_id: r for r in got}
    text = {(c, t): x for c, t, _, x in rows}
    found = cands.collect()
    assert len(found) == 12 * TB.N_CANDIDATES
    for r in found:
        conv, turn = by_id[r.paired_id].example[1:].split(" t")
        assert by_id[r.paired_id].counterfactual == text[int(conv), int(turn) + 1]
        assert r.generated == text.get((int(conv), int(turn) + 2 + r.idx))
    assert {r.paired_id for r in got if r.paired_id >= 0} == {7 * far, 7 * far + 2, 8 * far, 8 * far + 2}


def test_pair_keys_are_distinct_or_an_error(spark):
    far = [-(1 << 30), -3, -2, -1, 0, 1, 2, 3, TB.TURNS - 1, TB.TURNS, TB.TURNS + 1, (1 << 30) - 2, (1 << 30) - 1]
    df = spark.createDataFrame([(c, t) for c in far for t in far], "c long, t long")
    keys = [r[0] for r in df.select(TB.pair_key(F.col("c"), F.col("t"))).collect()]
    assert len(set(keys)) == len(far) ** 2 and min(keys) >= -(1 << 63)
    assert spark.createDataFrame([((1 << 43) - 1, 5)], "c long, t long").select(TB.pair_key(F.col("c"), F.col("t"))).first()[0] == ((1 << 43) - 1) * TB.TURNS + 5
    with pytest.raises(Exception, match="no pair id"):
        spark.createDataFrame([(1 << 43, TB.TURNS)], "c long, t long").select(TB.pair_key(F.col("c"), F.col("t"))).collect()


def test_hashed_conversation_ids_get_pairs(spark, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, -5, 1 << 50, 3, -2]
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"c{c} t{k}") for c in ids for k in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs, cands = TB.conversation_pairs(spark, str(tmp_path))
    got = pairs.collect()
    assert len(got) == 18 and len({r.paired_id for r in got}) == 18 and {r.label_ex for r in got} <= {0, 1}
    assert {r.paired_id for r in got if r.paired_id >= 0} == {3 * TB.TURNS + k for k in (0, 2, 4)}
    by_id = {r.paired_id: r for r in got}
    for r in cands.collect():
        c, t = by_id[r.paired_id].example[1:].split(" t")
        k = int(t) + 2 + r.idx
        assert r.generated == (f"c{c} t{k}" if k < 6 else None)


def test_pairs_meet_their_candidates_without_an_exchange(spark):
    d = "/root/testdata/sf0.001"
    pairs, cands = TB.conversation_pairs(spark, d)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = cands.join(pairs, "paired_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again, _ = TB.conversation_pairs(spark, d)
    assert again.inputFiles() == pairs.inputFiles()  # made once
