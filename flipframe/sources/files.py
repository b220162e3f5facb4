"""Scans and sinks: TSV/CSV with explicit schemas, headerless text, folder-labelled files,
multi-file runs, fold store, metrics table, feature cache.

Delimited files whose quoted fields hold line ends are read in splits (``sources/quoted.py``).  What is
read more than once is landed as parquet (``land_parquet``), where predicate pushdown and column
pruning apply.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flipframe.functions.text import NA_TOKENS, null_tokens_to_null
from flipframe.session import shuffle_partitions
from flipframe.sources.quoted import read_quoted, records

#: What from_csv needs beside the separator: an empty field is null, a quoted empty one is a text.
FIELD_OPTIONS = {"nullValue": "\u0000null\u0000", "emptyValue": ""}
#: For the streaming source, which has only Spark's own reader.
TSV_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "nullValue": "\u0000null\u0000", "emptyValue": ""}


def read_tsv(spark: SparkSession, path, schema: StructType | str, na_tokens: Sequence[str] | None = NA_TOKENS) -> DataFrame:
    """Header TSV with quoted fields (newlines, tabs, doubled quotes survive).

    Spark keeps ``NA``/``NaN``/... as text; what pandas would read as missing is nulled
    explicitly for the string columns (``na_tokens=None`` keeps the raw text).
    """
    df = read_quoted(spark, path, schema, "\t", options=FIELD_OPTIONS)
    if na_tokens is None:
        return df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            df = df.withColumn(f.name, null_tokens_to_null(F.col(f.name), na_tokens))
    return df


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header TSV sink; nulls are written as empty fields, empty strings as quoted ``""``."""
    (df.write.mode(mode).option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').csv(path))


def land_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write a scanned file table as Parquet once; later stages read the columnar, splittable copy."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_column(spark: SparkSession, path, column: str, schema: StructType | str | None = None) -> DataFrame:
    """Comma CSV with header, one column projected; without a schema, the header names text columns."""
    if schema is None:
        head = records(spark, path, ",").where("first").select("record").first()
        names = next(csv.reader([head.record])) if head else [column]
        schema = ", ".join(f"`{n}` string" for n in names)
    return read_quoted(spark, path, schema, ",").select(column)


def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """Headerless one-text-per-line sink; texts holding a newline are quoted (CSV rules)."""
    df.select(col).write.mode(mode).option("header", "false").option("quote", '"').option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path, col: str = "text") -> DataFrame:
    """Headerless one-text-per-record scan, the inverse of :func:`write_lines`."""
    return read_quoted(spark, path, f"`{col}` string", ",", header=False)


def read_text_corpus(spark: SparkSession, path) -> DataFrame:
    """Raw text lines with their place in the stream: ``line_id`` is 0..n-1 in (file path, byte)
    order, however the reader packs file splits into tasks.

    Inside a split the reader keeps the file's order, so (file, split start, order in the task)
    is the stream order; its global position comes from range partitions and their counts.
    """
    from flipframe.operators.positions import global_position

    df = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"))
    return global_position(df, ["file", "_start", "_nth"], "line_id").drop("_start", "_nth")


#: What Spark writes as %XX in the name of a partition's folder, and the folder of a null or empty value.
FOLDER_ESCAPES = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_folder_files(df: DataFrame, folder_col: str, text_col: str, path: str) -> None:
    """One file per row, its text and a newline, below ``path/<folder_col>=<value>/`` as ``partitionBy`` names it.

    On any other store the rows go through Spark's text sink.  Its local file system starts a process for the
    mode of each file that it creates and of its checksum, which costs far more than the file, so on a
    local (or mounted) folder the tasks write their files themselves.  A task that is run again writes the same names.
    """
    where = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if not where:
        df.select(folder_col, text_col).write.option("maxRecordsPerFile", 1).partitionBy(folder_col).text(path)
        return
    root = where[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for value, text in zip(*(c.to_pylist() for c in batch.columns)):
                name = FOLDER_ESCAPES.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NULL_FOLDER
                folder = f"{root}/{folder_col}={name}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{folder}/part-{part:05d}-{n:09d}.txt", "wb") as f:
                    f.write((text or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    os.makedirs(root, exist_ok=True)  # for a table without rows
    rows = df.select(F.col(folder_col).cast("string"), F.col(text_col).cast("binary"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_folder_labelled(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root/<class>/`` is one row; label = rank of its sorted folder name.

    A scan plans a few small files per task, which would be more tasks than a scheduler likes, so they are
    gathered into as many as a shuffle has.  The classes come from the names alone, without the contents, and
    are broadcast: no text is shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.col("content").cast("string").alias("text"), F.col("_metadata.file_path").alias("path"))
    files = files.withColumn("folder", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)).coalesce(shuffle_partitions(spark))
    # the distinct folder list is tiny (one row per class)
    classes = files.select("folder").distinct().withColumn(
        "label", (F.dense_rank().over(Window.orderBy("folder")) - 1).cast("int"))
    return files.join(F.broadcast(classes), on="folder").select("path", "folder", "label", "text")


def read_runs(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Several candidate files in one scan; ``file_path`` and ``file_name`` say which run each row came from."""
    df = read_quoted(spark, paths, schema, "\t", options=FIELD_OPTIONS, file_col="file_path")
    return df.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))


def parse_run_name(name_col) -> tuple:
    """``lm@prompt-1@fold-0`` -> ('1', '0'); a name without '@' -> ('None', '0')."""
    name = F.col(name_col) if isinstance(name_col, str) else name_col
    parts = F.split(name, "@", -1)
    has = F.size(parts) > 1
    prompt = F.when(has, F.get(F.split(F.get(parts, 1), "-", -1), 1)).otherwise(F.lit("None"))
    fold = F.when(has, F.get(F.split(F.get(parts, 2), "-", -1), 1)).otherwise(F.lit("0"))
    return prompt, fold


def write_folds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fold store: one directory per (fold, split)."""
    df.write.mode(mode).partitionBy("fold", "split").parquet(path)


def read_fold(spark: SparkSession, path: str, fold: int, split: str | None = None) -> DataFrame:
    """Partition-pruned read of one fold (and split)."""
    df = spark.read.parquet(path).filter(F.col("fold") == fold)
    return df.filter(F.col("split") == split) if split is not None else df


def append_metrics(row: DataFrame, path: str, run: str, tags: dict | None = None) -> None:
    """Metrics sink: a wide one-row result becomes long (run, metric, value) rows of the table.

    Each run owns the folder ``run=<name>`` and rewrites it whole, so re-running (or retrying) a
    run replaces its rows instead of appending duplicates; other runs are untouched.
    :func:`read_metrics` gives ``run`` back as text.
    """
    value_cols = [f.name for f in row.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    long = row.select(*[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        [], value_cols, "metric", "value")
    for k, v in (tags or {}).items():
        long = long.withColumn(k, F.lit(str(v)))
    long.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def read_metrics(spark: SparkSession, path: str, tags: Sequence[str] = ()) -> DataFrame:
    """The metrics table; the schema is stated, so a run called ``2023`` stays text."""
    schema = ", ".join(["metric string", "value double", *[f"`{t}` string" for t in tags], "run string"])
    return spark.read.schema(schema).parquet(path)


def commit_metrics(rows: DataFrame, path: str, sweep: str) -> None:
    """Metrics sink for a whole sweep: (run, metric, value, tags..) rows of any number of runs that readers
    see together or not at all.

    The rows go to a folder of their own; then a manifest that names it takes the place of the
    sweep's last one in one rename.  A job that fails before that leaves the table as it was, a
    repeated one replaces its sweep, and other sweeps are untouched.
    """
    spark = rows.sparkSession
    jvm, base = spark._jvm, path.rstrip("/")
    folder = f"data/{sweep}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{base}/{folder}")
    hadoop = jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{base}/manifests")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    new, final = hadoop.Path(f"{base}/manifests/.{uuid.uuid4().hex}"), hadoop.Path(f"{base}/manifests/{sweep}.json")
    out = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new)
    try:
        out.write(json.dumps({"sweep": sweep, "folder": folder}).encode())
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(new, final, how)


def read_committed_metrics(spark: SparkSession, path: str, tags: Sequence[str] = ()) -> DataFrame:
    """All committed sweeps of :func:`commit_metrics`, with their name as ``sweep``."""
    base = path.rstrip("/")
    schema = ", ".join(["run string", "metric string", "value double", *[f"`{t}` string" for t in tags]])
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifests")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], f"{schema}, sweep string")
    # one small file per sweep
    named = [json.loads(r.value) for r in spark.read.text(f"{base}/manifests/*.json", wholetext=True).collect()]
    out = spark.createDataFrame([], f"{schema}, sweep string")
    for m in sorted(named, key=lambda m: m["sweep"]):
        out = out.unionByName(spark.read.schema(schema).parquet(f"{base}/{m['folder']}").withColumn("sweep", F.lit(m["sweep"])))
    return out


def cached_features(spark: SparkSession, path: str, build, overwrite_cache: bool = False, params: dict | None = None) -> DataFrame:
    """Feature cache: build and write once, read afterwards (any Hadoop file system).

    The folder below ``path`` is named by a digest of ``params``, so other parameters never meet
    these features, and counts as a cache only with the commit marker ``_SUCCESS`` that Spark
    writes last: what a failed job left behind is overwritten.
    """
    digest = hashlib.sha256(json.dumps(params or {}, sort_keys=True, default=str).encode()).hexdigest()[:16]
    folder = f"{path.rstrip('/')}/{digest}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if overwrite_cache or not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
