"""The word tokens of a batch of texts in NumPy, by the JVM's own classes of characters.

The tokeniser's pattern only asks which class each character is in, so its regular expression is run once per
code point by Spark itself, and texts are cut by looking all their characters up in that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens

CODE_POINTS = 0x110000
GAP, WORD, ALONE = 0, 1, 2  # classes: between tokens, in a run that is one token, a token of its own
_CLASSES: dict[str, bytes] = {}  # by Spark application


def char_classes(spark: SparkSession) -> bytes:
    """The class of every code point, as the session's JVM has it."""
    app = spark.sparkContext.applicationId
    if app not in _CLASSES:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for x in batches if x.num_rows):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(0, 1), pa.array([b.column("c").to_numpy().astype(np.uint8).tobytes()], pa.binary())], names=["id", "c"])

        # after a byte order mark, as U+FEFF itself would be taken for one
        one = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")
        ids = spark.range(0, CODE_POINTS, 1, 8).where(~F.col("id").between(0xD800, 0xDFFF))
        # two of a character are one token if it belongs in a run
        found = ids.select("id", F.size(word_tokens(F.concat(one, one))).alias("n"))
        kind = F.when(F.col("n") == 1, WORD).when(F.col("n") == 2, ALONE).otherwise(GAP)
        table = bytearray(CODE_POINTS)
        for r in found.select("id", kind.alias("c")).mapInArrow(pack, "id long, c binary").collect():
            # the surrogates, which are left out, may lie inside a batch
            at = r.id + np.arange(len(r.c))
            cut = int((at < 0xD800).sum()) if r.id < 0xD800 else len(r.c)
            table[r.id : r.id + cut] = r.c[:cut]
            table[0xE000 : 0xE000 + len(r.c) - cut] = r.c[cut:]
        _CLASSES[app] = bytes(table)
    return _CLASSES[app]


def cut_texts(col: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lines of each text (none of a null one), tokens of each line, and the tokens."""
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    parts = col.cast(pa.binary()).drop_null().to_pylist()
    blob = b"".join(parts)
    try:
        chars = None if blob.isascii() else np.frombuffer(blob.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no character count as U+FFFD, as in the JVM
        parts = [p.decode(errors="replace").encode() for p in parts]
        blob = b"".join(parts)
        chars = np.frombuffer(blob.decode().encode("utf-32-le"), np.uint32)
    size = np.zeros(len(col), np.int64)
    size[valid] = [len(p) for p in parts]
    at = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(blob, np.uint8)
    if chars is None:
        chars, wide = raw, None
    else:
        wide = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    kind = classes[chars]
    begins = kind == WORD
    begins[1:] &= kind[:-1] != WORD
    edge = at[:-1][at[:-1] < len(kind)]
    begins[edge] = kind[edge] == WORD
    begins |= kind == ALONE
    kept = kind != GAP
    before = np.concatenate([[0], np.cumsum(begins)])  # tokens that begin before a character
    data = raw[kept if wide is None else np.repeat(kept, wide)]
    ends = np.concatenate([[0], np.cumsum(kept if wide is None else np.where(kept, wide, 0))])[np.append(np.flatnonzero(begins), len(kind))]
    ends[-1] = len(data)
    tokens = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    feeds = np.flatnonzero(chars == 10)
    lines = np.where(valid, np.diff(np.searchsorted(feeds, at)) + 1, 0)
    starts = np.sort(np.concatenate([at[:-1][valid], feeds + 1]), kind="stable")
    return lines, np.diff(before[np.append(starts, len(kind))]), tokens
