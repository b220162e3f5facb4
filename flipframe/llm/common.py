"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Rows and text bytes handed to a scan function at a time, which bounds a Python worker's memory.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20

#: Word bytes of the contracts' pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased:
#: digits, a-z and every byte of a non-ASCII character; everything else becomes a blank.
_WORD_MAP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def scaled(x):
    """Rows of a matrix scaled by a power of two to components below 1, in double precision: exact, and
    neither squares nor products of tiny or huge components vanish or overflow."""
    import numpy as np

    x = np.asarray(x, np.float64)
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -e)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of A-Z lower-cased UTF-8 text; null gives none.

    Every byte of a non-ASCII character is a word byte, so splitting bytes equals splitting
    characters.
    """
    return [] if text is None else text.translate(_WORD_MAP).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], want: str) -> str:
    """``want``, lengthened until no column of ``taken`` has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while want.lower() in low:
        want += "_"
    return want


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends there, and a
    lost executor costs a read instead of a recomputation.  Returns the table and its path."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file to the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    out = fs.create(p)
    try:
        out.write(data)
    finally:
        out.close()


def _slices(batch: pa.RecordBatch, size: pa.Array) -> Iterator[pa.RecordBatch]:
    start = total = 0
    for i, n in enumerate(size):
        if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def scan_texts(
    df: DataFrame,
    text_col: str,
    make_scan: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
    result: T.StructType,
    keep: list[str] | None = None,
    out: str = "scan",
) -> tuple[DataFrame, str]:
    """Add a struct column of per-text results to ``df`` in one narrow Arrow pass.

    ``make_scan()`` runs once per task and returns a function from a list of UTF-8 texts (None
    for null) to one list per result field.  ``keep`` names the input columns that travel on
    (default: all).  Returns the frame and the struct column's name, which avoids the input's.
    """
    keep = list(df.columns) if keep is None else keep
    out = free_name(df.columns, out)
    carried = [c for c in df.columns if c in set(keep) | {text_col}]
    src = df.select(*[F.col(f"`{c}`") for c in carried])
    text = F.col(f"`{text_col}`").cast("string")
    probe = free_name(carried, "utf8")
    src = src.select("*", text.alias(probe))
    if text_col not in keep:
        src = src.drop(text_col)
    schema = T.StructType([f for f in src.schema.fields if f.name in keep] + [T.StructField(out, result)])
    names = [f.name for f in schema.fields[:-1]]
    fields = [f.name for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in result.fields]
        scan = None
        for batch in batches:
            scan = scan or make_scan()
            col = batch.column(batch.schema.get_field_index(probe))
            for part, texts in _text_slices(batch, col):
                got = scan(texts)
                struct = pa.StructArray.from_arrays(
                    [pa.array(got[f], type=t) for f, t in zip(fields, types)], names=fields
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names] + [struct], names=[*names, out]
                )

    return src.mapInArrow(run, schema), out


def _text_slices(batch: pa.RecordBatch, col: pa.Array):
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at = 0
    for part in _slices(batch, size):
        texts = col.slice(at, part.num_rows)
        at += part.num_rows
        yield part, texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers and the shared folder known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
