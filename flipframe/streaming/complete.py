"""Complete pairs from a stream of candidate files, by keyed state.

The candidates of a pair may arrive in any number of files and triggers, and a file may be
delivered again.  The state of a (run, pair) holds the candidates seen so far; a candidate number
that is there already is dropped.  When all ``n`` are there the pair is emitted once, unless one of them
is null (such pairs are removed, as in the batch rule), and its texts leave the state: what
stays of a finished pair is its key and a flag, so that later deliveries are known.

Each micro-batch writes the pairs that it completed to a folder of its own, which a replay
overwrites; with the stream's checkpoint every pair is therefore in the table exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flipframe.session import ship_package
from flipframe.sources.files import TSV_OPTIONS
from flipframe.streaming.runs import run_name_from_path

CANDIDATE_SCHEMA = "paired_id long, idx int, generated string"
PAIR_SCHEMA = "run string, paired_id long, candidates array<string>"
STATE_SCHEMA = "idx array<int>, texts array<string>, done boolean"


def candidate_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming rows (paired_id, idx, generated, run) of the candidate files below ``folder``."""
    df = (spark.readStream.schema(CANDIDATE_SCHEMA).options(**TSV_OPTIONS).option("recursiveFileLookup", "true")
          .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return df.withColumn("run", run_name_from_path("_metadata.file_path"))


def collect_candidates(n: int):
    """State function: candidates of one (run, pair) -> its row once it is complete."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, texts, done = state.get if state.exists else ([], [], False)
        have = dict(zip(idx, texts))
        for pdf in batches:  # read to the end, also for a finished pair
            if done:
                continue
            for i, text in zip(pdf["idx"], pdf["generated"]):
                if 0 <= i < n:
                    have.setdefault(int(i), text)
        if done:
            return
        if len(have) < n:
            state.update((sorted(have), [have[i] for i in sorted(have)], False))
            return
        state.update(([], [], True))
        if all(have[i] is not None for i in range(n)):
            yield pd.DataFrame({"run": [key[0]], "paired_id": [key[1]], "candidates": [[have[i] for i in range(n)]]})

    return step


def complete_pairs(rows: DataFrame, n: int) -> DataFrame:
    """(run, paired_id, candidates) of pairs as they become complete."""
    return rows.groupBy("run", "paired_id").applyInPandasWithState(
        collect_candidates(n), PAIR_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def collect_folder(spark: SparkSession, folder: str, sink_path: str, checkpoint_path: str, n: int, max_files_per_trigger: int = 64):
    """Start (or resume) the stream over the files present; :func:`read_pairs` reads its table."""
    ship_package(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    pairs = complete_pairs(candidate_stream(spark, folder, max_files_per_trigger), n)
    return pairs.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def read_pairs(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).parquet(sink_path).select("run", "paired_id", "candidates")
