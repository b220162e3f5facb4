"""Delimited files with quoted fields, read in splits.

A quoted field may hold line ends, so whether a line starts a record depends on everything before
it.  Spark's ``multiLine`` reader therefore gives a whole file to one task.  Here files are read
as plain lines in any number of splits, in two narrow passes:

1. Each split is reduced to what it does to the reader's state: the state at its end if it starts
   outside of quotes, and if it starts inside.  These two bits compose, and windows over the small table of
   splits give the state in which every split really starts.
2. Each split joins its lines to records from that state on.  Only the pieces of records that cross a
   split's border (two a split at most) are shuffled and joined.

The records are then parsed by ``from_csv``.  A field is quoted if it starts with the quote; a doubled
quote inside stands for one, and after the closing quote the field goes on to the next separator.
Quotes elsewhere are plain text.  Lines end with a line feed, or carriage return and line feed.
Blank lines between records are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flipframe.session import scratch_table, ship_package

WHOLE, HEAD, MIDDLE, TAIL = range(4)  # a record, or the pieces of one that crosses borders


def ends_inside(line: str, inside: bool, sep: str, quote: str = '"') -> bool:
    """Whether a reader that starts ``line`` outside or inside of a quoted field ends it inside."""
    at = 0
    if not inside:
        if line.startswith(quote):
            at, inside = len(quote), True
        else:
            at = line.find(sep + quote)
            if at < 0:
                return False
            at += len(sep) + len(quote)
    while True:
        end = line.find(quote, at)
        while end >= 0 and line.startswith(quote, end + len(quote)):  # a doubled quote
            end = line.find(quote, end + 2 * len(quote))
        if end < 0:
            return True
        at = line.find(sep + quote, end + len(quote))
        if at < 0:
            return False
        at += len(sep) + len(quote)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their split (file, start of its bytes) and their order in the task."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, first row, end row) of each run of rows of one split."""
    files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
    lo = 0
    for k in range(1, batch.num_rows + 1):
        if k == batch.num_rows or starts[k] != starts[lo] or files[k] != files[lo]:
            yield files[lo], starts[lo], lo, k
            lo = k


def split_states(lines: DataFrame, sep: str, quote: str = '"') -> DataFrame:
    """(file, start, inside): whether each split starts inside of a quoted field."""

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, outer, inner = None, False, True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([outer]), pa.array([inner])], names=["file", "start", "outer", "inner"])

        for batch in batches:
            text = batch.column("value")
            for file, start, lo, hi in _runs(batch):
                if (file, start) != now:
                    if now is not None:
                        yield row()
                    now, outer, inner = (file, start), False, True
                part = text.slice(lo, hi - lo)
                # a line without a quote changes nothing
                for line in part.filter(pc.match_substring(part, quote)).to_pylist():
                    same = outer == inner
                    outer = ends_inside(line, outer, sep, quote)
                    inner = outer if same else ends_inside(line, inner, sep, quote)
        if now is not None:
            yield row()

    effects = lines.select("value", "file", "start").mapInArrow(effect, "file string, start long, outer boolean, inner boolean")
    # a split either fixes the state, keeps it or turns it round: the state is that of the last split
    # that fixed it, turned as often as splits have turned it since
    order = Window.partitionBy("file").orderBy("start")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("outer") & ~F.col("inner")).cast("int")).over(upto), F.lit(0))
    fixed = effects.withColumn("turns", turns).withColumn(
        "fix", F.when(F.col("outer") == F.col("inner"), F.struct(F.col("outer").cast("int").alias("state"), F.col("turns").alias("turns"))))
    last, turned = F.last("fix", ignorenulls=True).over(before), F.coalesce(F.max("turns").over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + turned - F.coalesce(last["turns"], F.lit(0))
    return fixed.select("file", "start", (state % 2 == 1).alias("inside"))


def records(spark: SparkSession, paths, sep: str, quote: str = '"') -> DataFrame:
    """One row per record: file, record (its text without the line end) and first (of its file)."""
    ship_package(spark)
    lines = _lines(spark, paths)
    # one small row per split, written so that its size is known: the optimiser broadcasts it below its
    # threshold and shuffles by split above; the sort keeps each split's lines in order either way
    states = scratch_table(split_states(lines, sep, quote), "split-states")
    known = lines.join(states, ["file", "start"]).sortWithinPartitions("file", "start", "nth")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, piece, kind, first = None, False, [], WHOLE, False
        out: dict[str, list] = {n: [] for n in ("file", "start", "kind", "first", "record")}

        def put(k: int) -> None:
            for n, v in zip(out, (now[0], now[1], k, first, "\n".join(piece))):
                out[n].append(v)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out["file"], pa.string()), pa.array(out["start"], pa.int64()), pa.array(out["kind"], pa.int32()),
                 pa.array(out["first"], pa.bool_()), pa.array(out["record"], pa.string())], names=list(out))
            for v in out.values():
                v.clear()
            return made

        for batch in batches:
            text = batch.column("value")
            begins = batch.column("inside")
            quoted = pc.match_substring(text, quote).to_pylist()
            values = text.to_pylist()
            for file, start, lo, hi in _runs(batch):
                if (file, start) != now:
                    if piece:  # the last split ended inside of a record
                        put(HEAD if kind == WHOLE else MIDDLE)
                    now, piece = (file, start), []
                    inside = begins[lo].as_py()
                    kind, first = (TAIL if inside else WHOLE), start == 0
                for k in range(lo, hi):
                    line = values[k]
                    inside = ends_inside(line, inside, sep, quote) if quoted[k] else inside
                    piece.append(line)
                    if not inside:
                        if kind == TAIL or len(piece) > 1 or line not in ("", "\r"):
                            put(kind)
                            first = False
                        piece, kind = [], WHOLE
            yield flush()
        if piece:
            put(HEAD if kind == WHOLE else MIDDLE)
            yield flush()

    parts = known.mapInArrow(join, "file string, start long, kind int, first boolean, record string")
    whole = parts.where(F.col("kind") == WHOLE).select("file", "record", "first")
    torn = parts.where(F.col("kind") != WHOLE)
    # a head opens a record, the pieces up to the next head belong to it; in a split the tail comes first
    nth = F.sum((F.col("kind") == HEAD).cast("int")).over(
        Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct("start", (-F.col("kind")).alias("k"), "record")
    mended = (
        torn.withColumn("nth", nth).groupBy("file", "nth")  # the pieces of one record
        .agg(F.sort_array(F.collect_list(piece))["record"].alias("pieces"), F.max("first").alias("first"))
        .select("file", F.array_join("pieces", "\n").alias("record"), "first")
    )
    return whole.unionByName(mended).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, sep: str = "\t", header: bool = True,
                options: dict[str, str] | None = None, file_col: str | None = None) -> DataFrame:
    """The records of delimited files as columns of ``schema`` (by position), from any number of splits.

    ``header`` drops the first record of each file; ``options`` go to ``from_csv``.
    """
    rows = records(spark, paths, sep)
    if header:
        rows = rows.where(~F.col("first"))
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    opts = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", **(options or {})}
    parsed = F.from_csv("record", ddl, opts).alias("r")
    if file_col is None:
        return rows.select(parsed).select("r.*")
    return rows.select(parsed, F.col("file").alias(file_col)).select("r.*", file_col)
