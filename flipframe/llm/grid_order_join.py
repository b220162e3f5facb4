"""Embedding near-duplicates with an epsilon grid order join.

For unit vectors, cosine >= c means a distance of at most eps = sqrt(2 - 2c).  Vectors are
projected on their leading principal directions, which never lengthens a distance, put into grid
cells of side eps and sorted by cell, first direction first.  The sorted sequence of each label
is cut into blocks.  Two blocks whose cell boxes lie more than a cell apart in any direction
can't hold a link and are skipped before any vector moves; the rest are joined recursively: a
pair of intervals is dropped when the distance between their boxes exceeds eps, halved while it
is large, and compared directly when it is small.

Links are counted, not listed: a block pair yields the number of partners of each vector and a
spanning forest of its links, both linear in the block size, so dense groups cost no pairs.
Equal vectors of a label are handled once, with their multiplicity.

Only vectors of equal label and equal length are compared, in double precision and scaled by a power of
two, so that tiny and huge components count like any others.  Rows with a null
label, a null or zero vector, or null or non-finite components link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flipframe.llm.common import ready, scaled, written
from flipframe.llm.components import connected
from flipframe.session import shuffle_partitions

COSINE = 0.93
DIMS = 6  # leading principal directions that order the grid
BLOCK = 2048  # vectors of a block; a block travels once for each block it may link with
LEAF = 64  # intervals up to this size are compared directly
SAMPLE_ROWS = 4096  # vectors on which the principal directions are fitted


def principal_directions(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal columns: the leading eigenvectors of the sample's covariance."""
    centred = vectors - vectors.mean(axis=0)
    _, v = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(v[:, ::-1][:, :dims])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with cosine >= ``cosine``; i < j when ``same``.

    ``pa_`` and ``pb`` are the projections of the unit vectors.
    """
    eps = np.sqrt(max(0.0, 2 - 2 * cosine))
    a, b = scaled(a), scaled(b)
    ua, ub = _unit(a), _unit(b)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    got_i, got_j = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        x, y = pa_[i0:i1], pb[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if (gap * gap).sum() > eps * eps + 1e-9:
            continue
        if i1 - i0 > LEAF or j1 - j0 > LEAF:
            if i1 - i0 >= j1 - j0:
                m = (i0 + i1) // 2
                todo += [(i0, m, j0, j1), (m, i1, j0, j1)]
            else:
                m = (j0 + j1) // 2
                todo += [(i0, i1, j0, m), (i0, i1, m, j1)]
            continue
        sim = ua[i0:i1] @ ub[j0:j1].T
        i, j = np.nonzero(sim >= cosine - 1e-9)
        i, j = i + i0, j + j0
        if same:
            i, j = i[i < j], j[i < j]
        exact = (a[i] * b[j]).sum(axis=1) / (na[i] * nb[j])
        got_i.append(i[exact >= cosine])
        got_j.append(j[exact >= cosine])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *got_i]), np.concatenate([none, *got_j])


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _matrix(flat: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(rows, -1)


_LINKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("links", T.LongType())])


def _join_blocks(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                side = []
                for s in "ab":
                    ids = np.asarray(col[f"{s}_ids"][r].values)
                    side.append((ids, np.asarray(col[f"{s}_copies"][r].values), _matrix(col[f"{s}_vecs"][r].values, len(ids)), _matrix(col[f"{s}_proj"][r].values, len(ids))))
                (ia, ca, va, xa), (ib, cb, vb, xb) = side
                same = col["a_block"][r].as_py() == col["b_block"][r].as_py()
                i, j = block_links(va, vb, xa, xb, cosine, same)
                if not len(i):
                    continue
                count_a = np.bincount(i, cb[j], len(ia)).astype(np.int64)
                count_b = np.bincount(j, ca[i], len(ib)).astype(np.int64)
                if same:
                    count_a, count_b = count_a + count_b, np.zeros(len(ib), np.int64)
                edges = _forest(ia[i], ib[j])
                node = [ia[count_a > 0], ib[count_b > 0], np.array([u for u, _ in edges], np.int64)]
                other = [np.full(len(node[0]) + len(node[1]), -1, np.int64), np.array([v for _, v in edges], np.int64)]
                links = [count_a[count_a > 0], count_b[count_b > 0], np.zeros(len(edges), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, other, links)], names=["node", "other", "links"])

    return run


def _classes(rows: DataFrame) -> DataFrame:
    """(label, vec, copies) for each distinct usable vector of each label."""
    return rows.where("usable").groupBy("label", "vec").agg(F.count("*").alias("copies"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, dims: int = DIMS, block: int = BLOCK, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (it is its component's smallest id).

    n_links counts every other row linked directly, copies included; rows that repeat a vec_id
    are separate rows.
    """
    spark = vectors.sparkSession
    ready(spark)
    # single-precision vectors travel as such; all arithmetic is in double precision
    single = vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType()) or vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), False)
    kind = "float" if single else "double"
    raw = F.col(f"`{vec_col}`").cast(f"array<{kind}>")
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(raw, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)).alias("vec"),  # -0.0 and 0.0 are one value
    ).withColumn("usable", F.coalesce(
        F.col("label").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0), F.lit(False)))
    classes, _ = written(spark, _classes(rows), "vector-classes")
    cells = _ordered(classes, cosine, dims, block)
    ordered, _ = written(spark, cells, "vector-order")
    found, _ = written(spark, _block_pairs(ordered, cosine), "vector-links")
    counts = found.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.where("other >= 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    placed = (
        ordered.select(F.col("label").alias("l"), F.col("vec").alias("x"), "copies", F.col("pos").alias("node"))
        .join(counts, "node", "left").join(roots, "node", "left")
        .select("l", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    )
    mine = rows.where("usable").join(placed, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("x"))).select("vec_id", "n", "root")
    linked, _ = written(spark, mine, "vector-rows")
    ids = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
    return linked.join(ids, "root").select("vec_id", "n", "component_id").unionByName(alone).select(
        "vec_id", F.col("n").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _ordered(classes: DataFrame, cosine: float, dims: int, block: int) -> DataFrame:
    """The classes with projection, global position and block in epsilon grid order."""
    spark = classes.sparkSession
    # per vector length: directions from a bounded sample, drawn by hash
    lengths = [r[0] for r in classes.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
    eps = float(np.sqrt(max(1e-12, 2 - 2 * cosine)))
    axes = {}
    for d in lengths:
        drawn = classes.where(F.size("vec") == d).orderBy(F.xxhash64("vec"), "label").limit(SAMPLE_ROWS).select("vec").collect()
        axes[d] = principal_directions(_unit(np.array([r.vec for r in drawn], float)), min(dims, d))
    sent = spark.sparkContext.broadcast(axes)  # dims directions for each vector length
    schema = T.StructType([*classes.schema.fields, T.StructField("proj", T.ArrayType(T.DoubleType())), T.StructField("cell", T.ArrayType(T.LongType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec"))
            proj = [(_unit(np.asarray(v.values, float)[None]) @ sent.value[len(v)])[0] for v in vecs]
            cell = [np.floor(p / eps).astype(np.int64) for p in proj]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(proj, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "proj", "cell"],
            )

    key = ["label", F.size("vec"), "cell", "proj", F.xxhash64("vec")]
    placed = classes.mapInArrow(project, schema)
    # global position: order by range, then rank within a partition plus the rows before it
    ranged, _ = written(spark, placed.repartitionByRange(shuffle_partitions(spark), *key).withColumn("part", F.spark_partition_id()), "vector-cells")
    per = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = per.select(F.col("part").alias("p"), F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1 + F.col("before")
    # as many offsets as shuffle partitions
    return ranged.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("pos", at).drop("part", "p", "before").withColumn("block", F.expr(f"pos div {block}"))


def _block_pairs(ordered: DataFrame, cosine: float) -> DataFrame:
    """Partner counts and forest links of all block pairs that may hold a link."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    own = ["label", "len", "block"]
    blocks = (
        ordered.withColumn("len", F.size("vec"))
        .groupBy(*own)  # at most BLOCK vectors each
        .agg(F.sort_array(F.collect_list(F.struct("pos", "copies", "vec", "proj"))).alias("rows"))
        .select(
            *own, F.col("rows.pos").alias("ids"), F.col("rows.copies").alias("copies"),
            F.flatten("rows.vec").alias("vecs"), F.flatten("rows.proj").alias("proj"),
        )
    )
    blocks, _ = written(ordered.sparkSession, blocks, "vector-blocks")
    dims = F.size("proj") / F.size("ids")
    bounds = lambda f: F.transform(F.sequence(F.lit(0), (dims - 1).cast("int")), lambda k: f(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.get("proj", (i * dims + k).cast("int")))))
    box = blocks.select(*own, bounds(F.array_min).alias("low"), bounds(F.array_max).alias("high"))
    box, _ = written(ordered.sparkSession, box, "vector-boxes")
    lo, hi = (F.floor(F.get(c, 0) / F.lit(eps or 1.0)).cast("long") for c in ("low", "high"))
    # blocks meet when their first-direction cell ranges touch: each side names its cells, one side
    # its neighbour cells too, and a pair is taken in the first cell that both name
    a = box.select(*[F.col(c).alias(f"a_{c}") for c in [*own, "low", "high"]], F.explode(F.sequence(lo - 1, hi + 1)).alias("c"), (lo - 1).alias("a_from"))
    b = box.select(*[F.col(c).alias(f"b_{c}") for c in [*own, "low", "high"]], F.explode(F.sequence(lo, hi)).alias("d"), lo.alias("b_from"))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("a_low", "a_high"), F.arrays_zip("b_low", "b_high"),
                   lambda x, y: F.greatest(F.lit(0.0), x["a_low"] - y["b_high"], y["b_low"] - x["a_high"])),
        F.lit(0.0), lambda acc, g: acc + g * g,
    )
    pairs = (
        a.join(b, (F.col("a_label") == F.col("b_label")) & (F.col("a_len") == F.col("b_len")) & (F.col("c") == F.col("d")) & (F.col("a_block") <= F.col("b_block")))
        .where((F.col("c") == F.greatest("a_from", "b_from")) & (gap <= eps * eps + 1e-9))
        .select("a_label", "a_len", "a_block", "b_block")
    )
    side = lambda s: blocks.select(F.col("label").alias("a_label"), F.col("len").alias("a_len"), *[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "copies", "vecs", "proj")])
    pairs, _ = written(ordered.sparkSession, pairs, "vector-pairs")
    # few pairs to a task: a task holds the vectors of all of its pairs
    tasks = max(shuffle_partitions(ordered.sparkSession), pairs.count() // 16 + 1)
    work = (
        pairs.join(side("a"), ["a_label", "a_len", "a_block"]).join(side("b"), ["a_label", "a_len", "b_block"])
        .select("a_block", "b_block", *[f"{s}_{c}" for s in "ab" for c in ("ids", "copies", "vecs", "proj")])
        .repartition(tasks, "a_block", "b_block")
    )
    return work.mapInArrow(_join_blocks(cosine), _LINKS)
