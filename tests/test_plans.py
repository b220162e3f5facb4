"""Plan checks: rows never travel keyed by a class, fold or candidate index alone."""

import re

import pytest
import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def exchanges(df):
    """(keys, columns) of every hash exchange, from the formatted plan without AQE."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for m in re.finditer(r"\(\d+\) Exchange\n(?:Input|Output) \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*)\), \w+", text):
        names = lambda s: re.findall(r"([A-Za-z_]\w*)#\d+", s)
        yield names(m[2].rsplit(",", 1)[0]), names(m[1])


@pytest.mark.parametrize("name", ["balanced_split", "balanced_nested_split", "kfold_val", "split_60_20_20", "exact_sample", "nested_samples", "spearman"])
def test_no_rows_travel_by_a_hot_key_alone(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = list(exchanges(E.queries()[name](spark, SF)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot = {"labels", "fold", "idx", "family", "_rest", "_in1", "_home"}
    ids = {"doc_id", "paired_id", "id", "_hk", "text", "generated"}
    for keys, columns in found:
        assert not (set(keys) <= hot and ids & set(columns)), (keys, columns)


def test_bleu_joins_nothing_and_shuffles_no_ngram(spark):
    from pyspark.sql import functions as F

    from flipframe.operators import ngram as NG

    base = spark.range(20).select(F.col("id"), F.lit(0).alias("idx"), F.split(F.lit("a b c d e"), " ").alias("t"))
    m = NG.match_table(base.withColumnRenamed("t", "hyp_tokens"), base.select("id", F.col("t").alias("ref_tokens")))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_text_is_not_sorted_in_aggregates(spark):
    for name in ("nli_first_match_rp", "nli_first_match_rh", "pair_pivot", "first_flip"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "SortAggregate" in x]
        assert not any(re.search(r"\b(text|generated|premise|hypothesis|example)#", x) for x in lines), name
