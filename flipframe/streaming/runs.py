"""Incremental evaluation of candidate files as they land in a folder.

The batch scripts evaluate "every file in the generation folder".  Here the folder is a
Structured Streaming file source: each trigger picks up only new files, and ``foreachBatch``
stores the sums and counts of each run in the batch.  A run's files may arrive in any number of
triggers: :func:`read_report` adds up all of a run's sums, so it has one exact row whatever the
cut.  The stream's checkpoint lives in the shared checkpoint folder, so a restarted job resumes
after the last committed file instead of re-scoring everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipframe.operators.models import parity_scorer
from flipframe.plans.suite import augmentation_sums, report_from_sums
from flipframe.sources.files import TSV_OPTIONS, parse_run_name

RUN_SCHEMA = "paired_id long, example string, label_counter int, generated string"


def run_name_from_path(path) -> F.Column:
    """Run name of a candidate file: its ``run=<name>`` folder, else the file name without extension."""
    folder = F.expr(f"url_decode(regexp_extract({path}, '/run=([^/]+)/', 1))")
    fname = F.regexp_extract(F.expr(path), r"/([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    return F.when(folder != "", folder).otherwise(fname)


def run_stream(spark: SparkSession, folder: str, schema: str = RUN_SCHEMA, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming DataFrame over the TSV candidate files below ``folder`` with a ``run`` per file.

    ``max_files_per_trigger`` only paces the micro-batches.
    """
    df = (spark.readStream.schema(schema).options(**TSV_OPTIONS).option("recursiveFileLookup", "true")
          .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return df.withColumn("run", run_name_from_path("_metadata.file_path"))


def report_batch(sink_path: str, scorer=parity_scorer):
    """foreachBatch function: sums per run of one micro-batch, stored below ``sink_path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on a retry: a replayed batch never duplicates rows
        (augmentation_sums(batch, "run", scorer=scorer)
         .write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}"))

    return write


def read_report(spark: SparkSession, sink_path: str) -> DataFrame:
    """One row per run over all micro-batches so far, with prompt and fold from the run's name."""
    prompt, fold = parse_run_name(F.col("run"))
    return report_from_sums(spark.read.parquet(sink_path)).withColumn("prompt", prompt).withColumn("fold", fold)


def evaluate_folder(spark: SparkSession, folder: str, sink_path: str, checkpoint_path: str,
                    available_now: bool = True, scorer=parity_scorer, max_files_per_trigger: int = 64):
    """Start (or resume) the incremental evaluation.  With ``available_now`` it processes the files
    present and stops; otherwise it keeps watching the folder."""
    w = (run_stream(spark, folder, max_files_per_trigger=max_files_per_trigger).writeStream.foreachBatch(report_batch(sink_path, scorer))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
