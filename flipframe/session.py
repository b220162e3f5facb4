"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "flipframe") -> SparkSession:
    """Session used by tests and the bench.  On a cluster the caller's own session is used instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, used for explicit-count repartitions.

    CPU-heavy per-row work after a shuffle of compact rows (token arrays before n-gram
    explosion, pairs before edit distance) must not be coalesced by AQE into a few tasks on the
    strength of a small byte size; a repartition with an explicit count keeps it spread.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to every core if its scan has fewer splits than there are cores.

    For CPU-heavy expressions over a small file, whose few row groups would keep most cores idle.
    Large inputs have more splits than cores and are left alone, so no large table is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flipframe`` importable in the Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per driver process and added with ``addPyFile`` once per
    SparkContext -- the programmatic form of ``--py-files``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="flipframe-pkg-"), "flipframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


# Suggested settings for a large cluster (about 100 TB of input, ~1,000 executors).  They are a
# starting point for the operator's own session, not applied by this library.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",   # post-shuffle partitions near 256 MB
    "spark.sql.adaptive.skewJoin.enabled": "true",               # split skewed join partitions
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.shuffle.partitions": "20000",                     # upper bound; AQE coalesces down
    "spark.sql.files.maxPartitionBytes": "256m",                 # scan split size
    "spark.sql.autoBroadcastJoinThreshold": "64m",               # AQE broadcasts only measured-small sides
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",      # Arrow batch size for model plug-ins
    "spark.checkpoint.dir": "<shared folder, e.g. a distributed file system path>",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is.  Only a ``local`` master may go
    without: a fresh folder under the system temp dir is then created and set.  Any other master
    must name one, as each node would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="flipframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage in a columnar form that later branches scan with pruned columns; the folder
    is deleted by :func:`drop_scratch`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is run inside go when it ends, not when the driver next collects its garbage.

    For tables that are written: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def input_digest(spark: SparkSession, path: str) -> str:
    """A digest of the files below ``path`` (name, length, time), by an aggregate over their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64("path", "length", "modificationTime")
    r = files.agg(F.bit_xor(one), F.sum(one.cast("decimal(38,0)")), F.count(F.lit(1)), F.sum("length")).first()
    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()[:16]


def bucketed_table(spark: SparkSession, name: str, build, by: str) -> DataFrame:
    """The table ``name``, bucketed and sorted by ``by``; made by ``build()`` if this session has none.

    Tables of one bucket count meet on ``by`` without an exchange.  The name must say what the table
    is made from, as :func:`input_digest` does.  Its files lie below the shared checkpoint folder.
    """
    n = shuffle_partitions(spark)
    name = f"{name}_b{n}"
    if spark.catalog.tableExists(name):
        where = _TABLES.get(name)  # deleted files, or another session's table: made again
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if where and mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    path = scratch_path(spark, name)
    build().repartition(n, by).write.option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(name)
    _TABLES[name] = path
    return spark.table(name)


_TABLES: dict[str, str] = {}  # folder of each bucketed table of this driver process


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this session, once nothing reads them any more."""
    for name in list(_TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        del _TABLES[name]
    base = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(ensure_checkpoint_dir(spark), "tables"))
    base.getFileSystem(spark._jsc.hadoopConfiguration()).delete(base, True)
