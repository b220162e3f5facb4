"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards of bounded size, and each shard gets a graph of its
own, so every row is indexed.  Nodes are inserted in batches of doubling size: a greedy beam
search from the entry node proposes neighbours (all nodes that it expands), and robust pruning
takes the nearest candidate, drops every other one that lies closer to it than to the node by the
factor ``alpha``, and goes on until the degree is full.  Edges are also added backwards, and a list that
overflows is pruned in the same way.  Nodes that no path reaches get an edge from a neighbour, or
become entries, so every node can be found.

A query is searched in every shard by a beam search; what its beam holds is scored again in
double precision on the original vectors, and the best of all shards are returned.  Searches run in lockstep
over a batch of queries, as whole-array operations.

Nearness is the cosine.  Vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths are not compared.  Vectors are scaled by a
power of two first, so tiny and huge components neither vanish nor overflow.  Equal vectors are
one node that holds its smallest ids, one more than can be asked for; rows that repeat an id and vector
count once.  A query never finds its own id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flipframe.llm.common import ready, scaled, written
from flipframe.session import shuffle_partitions

SHARD = 8192  # distinct vectors of a shard, about
DEGREE = 32  # out-edges of a node
BEAM = 64  # nodes a search keeps while the graph is built
SEARCH_BEAM = 128  # nodes a query keeps
ALPHA = 1.2  # an edge is dropped if another one comes nearer by this factor (squared distances)
WIDTH = 4  # nodes of a beam expanded at a time
BATCH = 512  # searches that run in lockstep


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, targets: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam searches for all ``targets`` in lockstep.

    Returns the beams (node numbers, nearest first, -1 where empty) and all nodes expanded.
    """
    n, rows = len(targets), np.arange(len(targets))
    seen = np.zeros((n, len(x)), bool)
    first = entries[np.argsort(-(targets @ x[entries].T), axis=1, kind="stable")[:, :beam]]
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, : first.shape[1]] = first
    dist[:, : first.shape[1]] = 2 - 2 * np.einsum("nd,ncd->nc", targets, x[first])
    fresh = ids >= 0
    seen[rows[:, None], first] = True
    final = np.full((n, beam), -1, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        at = np.arange(len(rows))
        chosen = np.full((len(rows), width), -1, np.int64)
        near = np.full((len(rows), width * links.shape[1]), -1, np.int64)
        for w in range(width):
            p = fresh.argmax(axis=1)
            has = fresh[at, p]
            chosen[has, w] = ids[at, p][has]
            fresh[at, p] = False
            got = links[chosen[:, w]]
            new = has[:, None] & (got >= 0)
            new &= ~seen[rows[:, None], np.where(new, got, 0)]
            r, c = np.nonzero(new)
            seen[rows[r], got[r, c]] = True
            near[r, w * links.shape[1] + c] = got[r, c]
        steps.append((rows, chosen))
        r, c = np.nonzero(near >= 0)
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = 2 - 2 * np.einsum("nd,nd->n", targets[rows[r]], x[near[r, c]])
        ids, dist = np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1)
        fresh = np.concatenate([fresh, near >= 0], axis=1)
        top = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(dist, top, 1), axis=1, kind="stable"), 1)
        ids, dist, fresh = (np.take_along_axis(m, top, 1) for m in (ids, dist, fresh))
        going = fresh.any(axis=1)
        if not going.all():
            final[rows[~going]] = ids[~going]
            rows, ids, dist, fresh = rows[going], ids[going], dist[going], fresh[going]
    expanded = np.full((n, width * len(steps)), -1, np.int64)
    for k, (r, chosen) in enumerate(steps):
        expanded[r, k * width : (k + 1) * width] = chosen
    return final, expanded


def robust_prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of ``nodes`` chosen from their candidates ``near`` (-1 where empty)."""
    out = np.full((len(nodes), degree), -1, np.int64)
    if not near.shape[1]:
        return out
    chunk = max(1, (1 << 23) // (near.shape[1] ** 2))
    for lo in range(0, len(nodes), chunk):
        p, c = nodes[lo : lo + chunk], near[lo : lo + chunk]
        away = np.where((c >= 0) & (c != p[:, None]), 2 - 2 * np.einsum("nd,ncd->nc", x[p], x[c]), np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        c, away = np.take_along_axis(c, order, 1), np.take_along_axis(away, order, 1)
        v = x[c]
        apart = np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1)))
        alive, at = np.isfinite(away), np.arange(len(p))
        for k in range(degree):
            i = alive.argmax(axis=1)
            has = alive[at, i]
            if not has.any():
                break
            out[lo + at[has], k] = c[at, i][has]
            alive &= alpha * apart[at, i] > away
            alive[at, i] = False
    return out


def _add_back_edges(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Link the new neighbours of ``nodes`` back to them; overfull lists are pruned."""
    degree = links.shape[1]
    r, c = np.nonzero(links[nodes] >= 0)
    src, dst = nodes[r], links[nodes][r, c]
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    known = (links[dst] == src[:, None]).any(axis=1)
    src, dst = src[~known], dst[~known]
    to, start, count = np.unique(dst, return_index=True, return_counts=True)
    have = (links[to] >= 0).sum(axis=1)
    rank = np.arange(len(dst)) - np.repeat(start, count)
    fits = have + count <= degree
    room = np.repeat(fits, count)
    links[dst[room], (np.repeat(have, count) + rank)[room]] = src[room]
    by_size = np.nonzero(~fits)[0]
    by_size = by_size[np.argsort(count[by_size], kind="stable")]
    for lo in range(0, len(by_size), 256):  # lists of like size together
        group = by_size[lo : lo + 256]
        near = np.full((len(group), degree + int(count[group].max())), -1, np.int64)
        near[:, :degree] = links[to[group]]
        for k, g in enumerate(group):
            near[k, degree : degree + count[g]] = src[start[g] : start[g] + count[g]]
        links[to[group]] = robust_prune(x, to[group], near, degree, alpha)


def _reached(links: np.ndarray, entries: list[int]) -> np.ndarray:
    got = np.zeros(len(links), bool)
    front = np.array(entries)
    while len(front):
        got[front] = True
        front = np.unique(links[front])
        front = front[front >= 0]
        front = front[~got[front]]
    return got


def _connect(links: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """Make every node reachable: by an edge from a reached out-neighbour, else as an entry."""
    entries = [entry]
    while True:
        got = _reached(links, entries)
        lost = np.nonzero(~got)[0]
        if not len(lost):
            return links, np.array(entries)
        out = links[lost]
        ok = (out >= 0) & got[out]
        has = ok.any(axis=1)
        if not has.any():
            entries.append(int(lost[0]))
            continue
        load = np.where(ok, (links >= 0).sum(axis=1)[out], len(links))
        via = out[np.arange(len(lost)), load.argmin(axis=1)]  # the shortest list takes the edge
        via, pick = np.unique(np.where(has, via, -1), return_index=True)  # one edge for each list at a time
        via, pick = via[via >= 0], pick[via >= 0]
        have = (links[via] >= 0).sum(axis=1)
        if have.max() == links.shape[1]:
            links = np.concatenate([links, np.full((len(links), 1), -1, links.dtype)], axis=1)
        links[via, have] = lost[pick]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges (-1 where empty) and entry nodes of the graph over unit vectors ``x``."""
    n = len(x)
    links = np.full((n, degree), -1, np.int64)
    middle = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(0).permutation(n)
    order = order[order != middle]
    entries, at, size = np.array([middle]), 0, 1
    while at < len(order):
        nodes = order[at : at + size]
        _, expanded = beam_search(x, links, entries, x[nodes], beam)
        links[nodes] = robust_prune(x, nodes, expanded, degree, alpha)
        _add_back_edges(x, links, nodes, alpha)
        at, size = at + size, min(2 * size, batch)
    return _connect(links, middle)


def search_graph(vectors: np.ndarray, x: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in each query's beam with their cosine in double precision (-1 and -inf where empty)."""
    ids, scores = [], []
    for lo in range(0, len(queries), batch):
        q = scaled(queries[lo : lo + batch])
        near, _ = beam_search(x, links, entries, unit(q), min(beam, len(x)))
        v = scaled(vectors[near].reshape(-1, vectors.shape[1])).reshape(*near.shape, -1)
        dot = np.einsum("nd,ncd->nc", q, v)
        norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=2))
        ids.append(near)
        scores.append(np.where(near >= 0, dot / norm, -np.inf))
    return np.concatenate(ids), np.concatenate(scores)


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of usable rows; single-precision vectors travel as such."""
    single = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and vectors.schema[vec_col].dataType.elementType == T.FloatType()
    kind = "float" if single else "double"
    raw = F.transform(F.col(f"`{vec_col}`").cast(f"array<{kind}>"), lambda v: F.when(v == 0, F.lit(0.0).cast(kind)).otherwise(v))  # -0.0 is 0.0
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), raw.alias("vec")).where(_usable(F.col("vec")))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def graph_index(vectors: DataFrame, per_node: int, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, degree: int = DEGREE,
                beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """The index, one row per shard: dim, shard, vectors and links as arrays of bytes, entries, and
    for every node its ``per_node`` smallest ids."""
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vec_col).distinct()
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    nodes = (
        rows.withColumn("nth", least).where(F.col("nth") <= per_node)  # limited before the shuffle too
        .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    nodes, _ = written(spark, nodes.withColumn("dim", F.size("vec")), "graph-nodes")
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).select(F.col("dim").alias("d"), F.expr(f"(n + {shard - 1}) div {shard}").alias("shards"))
    total = sizes.agg(F.sum("shards")).first()[0] or 0
    dealt = nodes.join(sizes, F.col("dim") == F.col("d")).select("dim", F.expr("pmod(xxhash64(vec), shards)").alias("shard"), "vec", "ids")
    tasks = shuffle_partitions(spark) + 2 * int(total)  # an explicit count keeps shards in tasks of their own
    id_type = nodes.schema["ids"].dataType
    spec = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("vectors", T.BinaryType()),
        T.StructField("links", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(id_type)),
    ])

    def build(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        dim, name = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        v = _matrix(group.column("vec"), dim)
        order = np.lexsort(v.T[::-1])  # the shard's graph doesn't depend on the order of arrival
        v = np.ascontiguousarray(v[order])
        links, entries = build_graph(unit(v), degree, beam, alpha)
        ids = group.column("ids").combine_chunks().take(pa.array(order))
        return pa.table(
            [
                pa.array([dim], pa.int32()), pa.array([name], pa.int64()), pa.array([v.tobytes()], pa.binary()), pa.array([links.astype("<i4").tobytes()], pa.binary()),
                pa.array([entries.tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(to_arrow_type(T.ArrayType(id_type))),
            ],
            names=["dim", "shard", "vectors", "links", "entries", "ids"],
        )

    return written(spark, dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, spec), "graph-index")[0]


def search_index(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found for each query row: query_id, rank (from 1), vec_id, score.

    ``queries`` has the same vector type as the indexed table.  Every query visits every shard of
    its vector length; a task streams a shard's graph and then its queries.
    """
    spark = queries.sparkSession
    asked, _ = written(spark, _rows(queries, id_col, vec_col).distinct().withColumn("q", F.monotonically_increasing_id()), "graph-queries")
    single = asked.schema["vec"].dataType.elementType == T.FloatType()
    id_type = index.schema["ids"].dataType.elementType.elementType
    sent = asked.join(index.select("dim", "shard"), F.size("vec") == F.col("dim")).select("dim", "shard", F.lit(1).alias("kind"), "q", "vec_id", "vec")
    stream = index.withColumn("kind", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    tasks = shuffle_partitions(spark) + 2 * index.count()
    spec = T.StructType([T.StructField("q", T.LongType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        graph, kind = None, to_arrow_type(id_type)

        def answer(q: list, own: list, vecs: pa.Array) -> pa.RecordBatch:
            vectors, x, links, entries, ids = graph
            near, score = search_graph(vectors, x, links, entries, _matrix(vecs, vectors.shape[1]), beam)
            out: tuple[list, list, list] = ([], [], [])
            for j, me in enumerate(own):
                best: list[tuple] = []
                for node in np.argsort(-score[j], kind="stable").tolist():
                    s = float(score[j, node])
                    if near[j, node] < 0 or (len(best) >= k and s < best[k - 1][0]):
                        break
                    best += [(s, i) for i in ids[near[j, node]].as_py() if i != me]
                    best.sort(key=lambda b: (-b[0], b[1] is not None, b[1] if b[1] is not None else 0))
                for s, i in best[:k]:
                    out[0].append(q[j])
                    out[1].append(i)
                    out[2].append(s)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.float64())], names=["q", "vec_id", "score"])

        for batch in batches:
            col = {n: batch.column(c) for c, n in enumerate(batch.schema.names)}
            kinds = np.asarray(col["kind"])
            heads = np.nonzero(kinds == 0)[0].tolist()
            for lo, hi in zip([-1, *heads], [*heads, len(kinds)]):
                if lo >= 0:
                    dim = col["dim"][lo].as_py()
                    vectors = np.frombuffer(col["vectors"][lo].as_buffer(), "<f4" if single else "<f8").reshape(-1, dim)
                    links = np.frombuffer(col["links"][lo].as_buffer(), "<i4").reshape(len(vectors), -1).astype(np.int64)
                    graph = (vectors, unit(vectors), links, np.array(col["entries"][lo].as_py()), col["ids"][lo].values)
                if hi > lo + 1:
                    part = slice(lo + 1, hi)
                    yield answer(col["q"].to_pylist()[part], col["vec_id"].to_pylist()[part], col["vec"].slice(lo + 1, hi - lo - 1))

    found = stream.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(run, spec)
    found, _ = written(spark, found, "graph-found")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id")))
    best = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **build) -> DataFrame:
    """Index ``vectors`` and search it for ``queries``, rows of the same table."""
    ready(vectors.sparkSession)
    index = graph_index(vectors, k + 1, id_col, vec_col, **build)
    return search_index(index, queries, k, id_col, vec_col)
