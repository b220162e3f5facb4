import os
import tempfile

import pytest

from flipframe.sources import files as IO


def test_line_ids_follow_the_stream(spark):
    folder = tempfile.mkdtemp(prefix="ff-corpus-")
    want = []
    for name, n in (("a.txt", 21_000), ("b.txt", 500), ("c.txt", 22_000)):
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        want += lines
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = IO.read_text_corpus(spark, folder).orderBy("line_id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.text for r in rows] == want and [r.line_id for r in rows] == list(range(len(want)))


def test_cache_serves_only_complete_features(spark):
    path = tempfile.mkdtemp(prefix="ff-cache-")
    built = []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    get = lambda n, **kw: IO.cached_features(spark, path, build(n), **kw).count()
    assert get(3, params={"b": 1}) == 3 and get(4, params={"b": 1}) == 3 and get(5, params={"b": 2}) == 5
    assert get(6, params={"b": 1}, overwrite_cache=True) == 6 and built == [3, 5, 6]
    for folder in os.listdir(path):
        os.remove(os.path.join(path, folder, "_SUCCESS"))  # as a failed job leaves it
    assert get(7, params={"b": 1}) == 7 and built == [3, 5, 6, 7]


def test_metrics_keep_run_names_as_text(spark):
    path = tempfile.mkdtemp(prefix="ff-metrics-")
    row = spark.createDataFrame([(0.5, 2)], "bleu double, n int")
    IO.append_metrics(row, path, "2023", {"lm": 7})
    IO.append_metrics(row, path, "base", {"lm": 8})
    IO.append_metrics(row, path, "base", {"lm": 8})
    got = IO.read_metrics(spark, path, tags=["lm"])
    assert dict(got.dtypes)["run"] == "string"
    assert sorted((r.run, r.metric, r.value, r.lm) for r in got.collect()) == [
        ("2023", "bleu", 0.5, "7"), ("2023", "n", 2.0, "7"), ("base", "bleu", 0.5, "8"), ("base", "n", 2.0, "8")]


def test_cluster_without_a_shared_folder_is_refused():
    from flipframe import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_a_sweep_is_seen_whole_or_not_at_all(spark):
    from pyspark.sql import functions as F

    path = tempfile.mkdtemp(prefix="ff-sweeps-")
    schema = "run string, metric string, value double, lm string"
    seen = lambda: sorted(map(tuple, IO.read_committed_metrics(spark, path, ["lm"]).collect()))
    assert seen() == []
    first = spark.createDataFrame([("r1", "bleu", 0.5, "a"), ("r2", "bleu", 0.6, "b")], schema)
    IO.commit_metrics(first, path, "grid")
    IO.commit_metrics(first.where("run = 'r1'"), path, "other")
    want = [("r1", "bleu", 0.5, "a", "grid"), ("r1", "bleu", 0.5, "a", "other"), ("r2", "bleu", 0.6, "b", "grid")]
    assert seen() == sorted(want)
    broken = first.repartition(4, "run").withColumn("value", F.when(F.col("run") == "r2", F.raise_error("lost").cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="lost"):
        IO.commit_metrics(broken, path, "grid")
    assert seen() == sorted(want)
    IO.commit_metrics(first.withColumn("value", F.col("value") + 1).where("run = 'r2'"), path, "grid")
    assert seen() == [("r1", "bleu", 0.5, "a", "other"), ("r2", "bleu", 1.6, "b", "grid")]


def test_the_corpus_has_more_than_four_files(spark, tmp_path):
    """Its ranges follow the input, so no task reads a quarter of it; the stream order stays."""
    import os

    import __spark_entry__ as entry
    from flipframe import session

    folder = str(tmp_path)
    spark.range(0, 400, 1, 12).selectExpr("399 - id AS doc_id", "concat('l', 399 - id, '\nsecond') AS text").write.parquet(f"{folder}/documents.parquet")
    base = os.path.join(session.ensure_checkpoint_dir(spark), "tables").removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = [r.text for r in entry.queries()["corpus_lines_scan"](spark, folder).orderBy("line_id").collect()]
    assert got == [x for i in range(400) for x in (f"l{i}", "second")]
    made = [n for n in set(os.listdir(base)) - before if n.startswith("corpus-")]
    assert len(made) == 1 and sum(n.endswith(".txt") for n in os.listdir(os.path.join(base, made[0]))) > 4


def test_folder_files_are_named_as_spark_names_them_and_read_in_few_tasks(spark, tmp_path):
    odd = ["en", "a b", "x/y=z", "p%q:'r\"", "#[t]^{", "\n\\*?", "é", "", None]
    rows = [(odd[k % len(odd)], None if k % 7 == 0 else f"text {k}\nü" * (k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    IO.write_folder_files(df, "lang", "text", f"{tmp_path}/own")
    IO.write_folder_files(df, "lang", "text", f"file://{tmp_path}/uri")
    df.write.option("maxRecordsPerFile", 1).partitionBy("lang").text(f"{tmp_path}/sink")
    got = {}
    for name in ("own", "uri", "sink"):
        read = IO.read_folder_labelled(spark, f"{tmp_path}/{name}")
        assert read.rdd.getNumPartitions() <= 8  # 400 files
        got[name] = sorted((r.folder, r.label, r.text) for r in read.collect())
    assert got["own"] == got["uri"] == got["sink"] and len(got["own"]) == len(rows)
    assert len({r[:2] for r in got["own"]}) == len(odd) - 1  # null and empty share a folder
