import os
import tempfile

from flipframe.streaming.runs import evaluate_folder, read_report


def _land(spark, folder, run, rows):
    df = spark.createDataFrame(rows, "paired_id long, example string, label_counter int, generated string")
    (df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", '"')
     .option("escape", '"').csv(os.path.join(folder, f"run={run}")))


def test_stream_reports_each_file_once_and_resumes(spark):
    base = tempfile.mkdtemp(prefix="ff-stream-")
    folder, sink, ckpt = (os.path.join(base, x) for x in ("landing", "report", "ckpt"))
    _land(spark, folder, "gpt2@prompt-1@fold-0", [(1, "a b", 1, "x y z"), (2, "c", 0, None)])
    _land(spark, folder, "gpt2@prompt-2@fold-1", [(1, "a b", 1, "x")])
    evaluate_folder(spark, folder, sink, ckpt).awaitTermination()
    first = {r.run: r for r in read_report(spark, sink).collect()}
    assert set(first) == {"gpt2@prompt-1@fold-0", "gpt2@prompt-2@fold-1"}
    r = first["gpt2@prompt-1@fold-0"]
    assert (r.n_removed, r.avg_len_seed, r.avg_len_counter, r.prompt, r.fold) == (1, 2.0, 3.0, "1", "0")

    _land(spark, folder, "baseline", [(3, "d e f", 0, "g")])
    evaluate_folder(spark, folder, sink, ckpt).awaitTermination()
    runs = [r.run for r in read_report(spark, sink).collect()]
    assert sorted(runs) == ["baseline", "gpt2@prompt-1@fold-0", "gpt2@prompt-2@fold-1"]


def test_run_of_many_files_gives_one_exact_row(spark):
    base = tempfile.mkdtemp(prefix="ff-stream-")
    folder, sink, ckpt = (os.path.join(base, x) for x in ("landing", "report", "ckpt"))
    rows = [(i, "a b", i % 2, None if i % 10 == 9 else " ".join("x" * (1 + i % 3))) for i in range(140)]
    df = spark.createDataFrame(rows, "paired_id long, example string, label_counter int, generated string")
    (df.repartitionByRange(70, "paired_id").write.option("sep", "\t").option("header", "true").option("quote", '"')
     .option("escape", '"').csv(os.path.join(folder, "run=big")))
    evaluate_folder(spark, folder, sink, ckpt, max_files_per_trigger=16).awaitTermination()
    assert len(os.listdir(sink)) > 1
    from flipframe.plans.suite import augmentation_report
    from pyspark.sql import functions as F

    want = augmentation_report(df.withColumn("run", F.lit("big"))).first()
    got = read_report(spark, sink).collect()
    assert len(got) == 1
    assert all(abs(got[0][c] - want[c]) < 1e-12 for c in ("n_removed", "label_flip", "confidence", "avg_len_seed", "avg_len_counter"))


def test_pairs_complete_over_files_replays_and_restarts(spark):
    from flipframe.streaming.complete import collect_folder, read_pairs

    base = tempfile.mkdtemp(prefix="ff-pairs-")
    folder, sink, ckpt = (os.path.join(base, x) for x in ("landing", "pairs", "ckpt"))

    def land(name, run, rows):
        df = spark.createDataFrame(rows, "paired_id long, idx int, generated string")
        df.coalesce(1).write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').csv(f"{folder}/{name}/run={run}")

    def go():
        collect_folder(spark, folder, sink, ckpt, 3, max_files_per_trigger=1).awaitTermination()
        return sorted((r.run, r.paired_id, tuple(r.candidates)) for r in read_pairs(spark, sink).collect())

    land("a", "r1", [(1, 0, "x0"), (1, 1, "x1"), (2, 0, "y0"), (3, 2, "z2")])
    land("b", "r1", [(1, 1, "other"), (2, 1, None), (1, 2, "x2"), (2, 2, "y2")])  # 1 completes, 2 has a null
    land("c", "r2", [(1, 0, "q0")])
    assert go() == [("r1", 1, ("x0", "x1", "x2"))]
    land("d", "r1", [(1, 0, "late"), (1, 1, "late"), (1, 2, "late"), (3, 0, "z0"), (3, 7, "no such slot")])  # a finished pair again
    land("e", "r2", [(1, 2, "q2"), (1, 1, "q1")])
    assert go() == [("r1", 1, ("x0", "x1", "x2")), ("r2", 1, ("q0", "q1", "q2"))]
    land("f", "r1", [(3, 1, "z1")])
    assert go() == [("r1", 1, ("x0", "x1", "x2")), ("r1", 3, ("z0", "z1", "z2")), ("r2", 1, ("q0", "q1", "q2"))]
