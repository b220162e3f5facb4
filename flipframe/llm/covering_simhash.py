"""SimHash near-duplicates found with covering locality-sensitive hashing.

Every bit of a fingerprint is given a non-zero code of radius + 1 bits.  Table t (a non-zero code
too) keeps the bits whose code has odd overlap with t and hides the others.  The codes of up to
``radius`` differing bits never span the whole code space, so some table hides all of them: every
pair within the radius agrees on the visible bits of at least one of the 2^(radius+1) - 1 tables.

Within a table's buckets no pairs are listed.  Two fingerprints within the radius have a point
halfway between them, at most radius / 2 bits from both; each fingerprint names the points that
near among the bits its table hides, and all that name one point are linked to the smallest of
them.  Whatever shares a point is within the radius, so the links are exact, and a point has a
bounded number of fingerprints however large a group of near copies is.

Texts: A-Z lower-cased, words split at blanks (space, 0x09-0x0D), ``shingle``-word shingles with
repeats; fewer words give one shingle of them all; null, empty and blank texts get fingerprint
zero and are linked like any other.  Equal texts share a fingerprint and are handled once.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flipframe.llm.common import free_name, ready, scan_texts, written
from flipframe.llm.components import connected

SHINGLE = 3
RADIUS = 2
SEED = 42
_CHUNK = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint as a signed 64-bit integer: a bit is 1 if set in over half of the shingles'
    XXH64 hashes."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    body = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = (end - length).tolist()
    k = min(shingle, len(words))
    last = end[k - 1 :].tolist()
    n = len(last)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        parts = [body[a:b] for a, b in zip(begin[at : at + _CHUNK], last[at : at + _CHUNK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def hidden_bits(radius: int = RADIUS, bits: int = 64) -> list[list[int]]:
    """The hidden bit numbers of each table."""
    codes = (1 << (radius + 1)) - 1
    return [[i for i in range(bits) if ((i % codes + 1) & t).bit_count() % 2 == 0] for t in range(1, codes + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints of a table of distinct ``fp`` within ``radius``
    bits (an even number), directly or through others within it."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: links are made at points halfway")
    tables = hidden_bits(radius)
    visible = [_signed((1 << 64) - 1 - sum(1 << b for b in bits)) for bits in tables]
    near = [
        [_signed(sum(1 << b for b in some)) for k in range(radius // 2 + 1) for some in combinations(bits, k)]
        for bits in tables
    ]
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for t, m in enumerate(visible)
        ])).alias("x"),
    ).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    points = F.transform(
        F.element_at(F.array(*[F.array(*[F.lit(d) for d in ds]) for ds in near]), (F.col("t") + 1).cast("int")),
        lambda d: F.col("fp").bitwiseXOR(d),
    )
    named = keyed.join(shared, ["t", "key"]).select("fp", F.explode(points).alias("p")).distinct()
    met = named.groupBy("p").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    links = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return links.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


_RESULT = T.StructType([T.StructField("fp", T.LongType(), False)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None, text_col: str = "text") -> tuple[DataFrame, str]:
    """Add a struct column with the fingerprint ``fp`` of every text."""
    ready(docs.sparkSession)
    return scan_texts(docs, text_col, lambda: lambda ts: {"fp": [simhash(t, shingle) for t in ts]}, _RESULT, keep, "simhash_scan")


def fingerprint_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for the rows (doc_id, fp): root is the component's smallest
    fingerprint, component_id the smallest doc_id reachable by links.  A component whose ids are
    all null has none."""
    least, _ = written(rows.sparkSession, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected(fingerprint_links(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    scanned, s = fingerprints(docs.select("doc_id", "text"), shingle, ["doc_id"])
    rows, _ = written(docs.sparkSession, scanned.select("doc_id", F.col(f"{s}.fp").alias("fp")), "simhash")
    return rows.join(fingerprint_classes(rows, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    A component of null ids keeps one row too.  Of rows that share the id, the one with the
    smallest text hash stays; of equal rows, any one.  The texts are shuffled once, keyed by id
    and text hash, so copies of a text don't meet in one task.
    """
    ident, h, nth = (free_name(docs.columns, x) for x in ("row_ident", "row_hash", "row_nth"))
    keyed = docs.withColumn(ident, F.coalesce(F.col("doc_id").cast("string"), F.lit("null id"))).withColumn(h, F.xxhash64("text"))
    scanned, s = fingerprints(keyed.select("doc_id", h, "text"), shingle, ["doc_id", h])
    rows, _ = written(docs.sparkSession, scanned.select("doc_id", F.col(h).alias("h"), F.col(f"{s}.fp").alias("fp")), "simhash")
    stay = (
        rows.join(fingerprint_classes(rows.select("doc_id", "fp"), radius), "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct("h", F.coalesce(F.col("doc_id").cast("string"), F.lit("null id")).alias("ident"))).alias("k"))
        .select(F.col("k.ident").alias(ident), F.col("k.h").alias(h))
    )
    one = Window.partitionBy(ident, h).orderBy("text")
    return keyed.join(stay, [ident, h]).withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
