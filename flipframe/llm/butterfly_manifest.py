"""Merkle manifest of a dataset by a butterfly exchange (DataFrame operations only).

The leaves of a source, in id order, form a tree of the given fanout; the roots of the sources,
in source order, form another one above it.  A member is an aligned block of fanout**LEVELS
consecutive leaves, which hashes its own subtree.  Members then exchange roots round by round: in
a round, the members that hold the same place within up to ``fanout`` neighbouring subtrees swap
those subtrees' roots, and each of them hashes the common ancestor for itself.  A member so meets
the siblings of its path on its way up, and holds its whole upper proof when it reaches the root;
nothing is passed down again.

Subtrees at the right edge, and sources of different sizes, have fewer members than their
neighbours.  A member i of a subtree of m members then stands in for all places p of the widest
neighbour with p mod m = i, so that every group is complete.  A round moves at most ``fanout``
times as many digests as there are members.

A null field hashes as ``-``.  Rows are ordered by id (null first), then by leaf digest: rows
that repeat an id are leaves of their own, and wholly equal rows are interchangeable.  A null source is a
source of its own and comes first.  An empty table gives an empty result.  Columns that are not
hashed are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.llm.common import ready, written
from flipframe.operators.positions import in_ranges, running_totals

FANOUT = 16
LEVELS = 3  # levels that a member hashes for itself: blocks of 16**3 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64  # hex digits of a node

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its UTF-8 length, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def lowered_where_sampled(id_col: Column, text: Column) -> Column:
    """The tampered text of a check: A-Z lower-cased where 5 divides the id's checksum."""
    hit = F.crc32(id_col.cast("string").cast("binary")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, _UPPER, _LOWER)).otherwise(text)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (left and right siblings of each level) lead to."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _step(run: Column, place: Column) -> Column:
    """Siblings in a run of joined digests, to the left and right of the node at ``place``."""
    cut = (place * DIGEST).cast("int")
    return F.struct(
        F.substring(run, F.lit(1), cut).alias("left"),
        F.substring(run, cut + 1 + DIGEST, F.length(run)).alias("right"),
    )


def _runs(nodes: Column, fanout: int) -> Column:
    """Joined digests of every ``fanout`` consecutive nodes."""
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""))


def _blocks(leaves: DataFrame, fanout: int, levels: int, carried: list[str]) -> DataFrame:
    """Aligned blocks of leaves with the runs of their lower levels and their subtree root."""
    size = fanout**levels
    order = ["key", "id", "leaf"]
    placed = running_totals(in_ranges(leaves, order), order[1:], F.lit(1).cast("long"), "pos", by=["key"], total_col="n_leaves")
    rows = (
        placed.withColumn("block", F.expr(f"pos div {size}"))
        .groupBy("key", "n_leaves", "block")  # at most `size` leaves each
        .agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", *carried))).alias("rows"))
    )
    # a source of one node needs no further level, so a small source ends inside its only block
    depth = sum(((F.col("n_leaves") > fanout**k).cast("int") for k in range(levels)), F.lit(0))
    rows = rows.withColumn("depth", depth)
    nodes = F.col("rows.leaf")
    for k in range(levels):
        runs = _runs(nodes, fanout)
        rows = rows.withColumn(f"runs{k}", F.when(F.col("depth") > k, runs))
        up = F.when(F.col("depth") > k, F.transform(f"runs{k}", lambda r: F.sha2(r, 256))).otherwise(nodes)
        rows = rows.withColumn(f"nodes{k + 1}", up)
        nodes = F.col(f"nodes{k + 1}")
    return rows.withColumn("node", F.get(nodes, 0)).drop(*[f"nodes{k + 1}" for k in range(levels)])


def _own_proof(row: Column, fanout: int, levels: int) -> Column:
    """Siblings of a leaf inside its block, as an array of one step per level."""
    size = fanout**levels
    steps = []
    for k in range(levels):
        at = F.floor((row["pos"] % size) / fanout**k).cast("int")
        run = F.get(f"runs{k}", F.floor(at / fanout).cast("int"))
        steps.append(F.when(F.col("depth") > k, _step(run, at % fanout)))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _exchange(members: DataFrame, scope: list[str], subtree: Column, place: Column, width: Column, group: Column,
              widest: Column, active: Column, fanout: int) -> DataFrame:
    """One round: swap roots within each group of subtrees, then hash the ancestor redundantly.

    ``subtree`` numbers the subtrees of a scope, ``place`` a member within its subtree of ``width``
    members, and ``widest`` is the width of the widest subtree of the group.
    """
    m = members.withColumn("g", group).withColumn("digit", F.pmod(subtree, F.lit(fanout))).withColumn("own", place)
    m = m.withColumn("active", active)
    # a subtree narrower than the widest one stands in for the places it lacks
    m = m.withColumn("p", F.explode(F.when(F.col("active"), F.sequence(F.col("own"), widest - 1, width)).otherwise(F.array(F.col("own")))))
    mine = F.col("p") == F.col("own")
    m = m.withColumn("proof", F.when(mine, F.col("proof")))  # copies carry the digest only
    met = F.sort_array(F.collect_list(F.struct("digit", "node")).over(Window.partitionBy(*scope, "g", "p")))  # at most `fanout` nodes
    m = m.withColumn("run", F.array_join(met["node"], "")).where(mine)
    return m.select(
        *[c for c in members.columns if c not in ("node", "proof")],
        F.when(F.col("active"), F.sha2("run", 256)).otherwise(F.col("node")).alias("node"),
        F.when(F.col("active"), F.concat("proof", F.array(_step(F.col("run"), F.col("digit"))))).otherwise(F.col("proof")).alias("proof"),
    )


def _rounds(most: int | None, fanout: int) -> int:
    n = 0
    while most and fanout**n < most:
        n += 1
    return n


def _sources(blocks: DataFrame, fanout: int) -> tuple[DataFrame, int]:
    """Rank of each source and, for each round, the width, first member and widest neighbour of
    its subtree; and the number of rounds."""
    spark = blocks.sparkSession
    per = blocks.groupBy("key").agg(F.count("*").alias("blocks"))
    ranged = in_ranges(per, ["key"])
    ranks = running_totals(ranged, ["key"], F.lit(1).cast("long"), "rank").select(F.col("key"), "blocks", "rank")
    firsts = running_totals(ranged, ["key"], F.col("blocks"), "first").select(F.col("key").alias("k"), "first")
    table, _ = written(spark, ranks.join(firsts, F.col("key") == F.col("k")).drop("k"), "merkle-sources")
    rounds = _rounds(table.count(), fanout)
    for r in range(rounds):
        inside = Window.partitionBy(F.expr(f"rank div {fanout**r}"))
        table = table.withColumn(f"width{r}", F.sum("blocks").over(inside)).withColumn(f"start{r}", F.min("first").over(inside))
        table = table.withColumn(f"widest{r}", F.max(f"width{r}").over(Window.partitionBy(F.expr(f"rank div {fanout ** (r + 1)}"))))
    return table, rounds


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
                    fanout: int = FANOUT, levels: int = LEVELS, claimed: Column | None = None) -> DataFrame:
    """One row per document: id, source, pos (in its source), leaf, subroot, root and proof, an
    array of (left, right) joined sibling digests from the leaf's run up to the root.

    ``claimed`` is the leaf digest of another version of the row, returned as ``claimed`` (null
    where it is not given) for a check against the proof.
    """
    spark = docs.sparkSession
    ready(spark)
    col = lambda c: F.col(f"`{c}`")
    source = col(source_col).cast("string")
    leaves = docs.select(
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("key"),  # '' precedes every '=...'
        col(id_col).alias("id"), leaf_digest([col(f) for f in fields]).alias("leaf"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    blocks, _ = written(spark, _blocks(leaves, fanout, levels, ["id", "claimed"]), "merkle-blocks")
    sources, upper = _sources(blocks, fanout)
    sized = blocks.select("key", "block", "node").join(sources, "key")
    members = sized.withColumn("proof", F.array().cast("array<struct<left:string,right:string>>"))
    lower = _rounds(sources.agg(F.max("blocks")).first()[0], fanout)
    for r in range(lower):
        w, up = fanout**r, fanout ** (r + 1)
        n = F.col("blocks")
        left = lambda k: F.lit(k).cast("long")
        members = _exchange(
            members, ["key"], F.expr(f"block div {w}"), F.expr(f"block % {w}"), F.least(left(w), n - F.expr(f"(block div {w}) * {w}")),
            F.expr(f"block div {up}"), F.least(left(w), n - F.expr(f"(block div {up}) * {up}")), n > w, fanout,
        )
    members = members.withColumn("subroot", F.col("node"))
    for r in range(upper):
        members = _exchange(
            members, [], F.expr(f"rank div {fanout**r}"), F.col("first") + F.col("block") - F.col(f"start{r}"), F.col(f"width{r}"),
            F.expr(f"rank div {fanout ** (r + 1)}"), F.col(f"widest{r}"), F.lit(True), fanout,
        )
    proofs, _ = written(spark, members.select("key", "block", "subroot", F.col("node").alias("root"), F.col("proof").alias("upper")), "merkle-proofs")
    row = F.explode(F.transform("rows", lambda x: F.struct(x.alias("row"), F.concat(_own_proof(x, fanout, levels), F.col("upper")).alias("proof"))))
    return (
        blocks.drop("node").join(proofs, ["key", "block"])
        .select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), "subroot", "root", row.alias("x"))
        .select(F.col("x.row.id").alias("doc_id"), "source", F.col("x.row.pos").alias("pos"), F.col("x.row.leaf").alias("leaf"),
                F.col("x.row.claimed").alias("claimed"), "subroot", "root", F.col("x.proof").alias("proof"))
    )


def checked_manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS, **kw) -> DataFrame:
    """The manifest checked against documents whose sampled texts were lower-cased: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.  A null id is never sampled."""
    changed = lowered_where_sampled(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    other = leaf_digest([changed if f == text_col else F.col(f"`{f}`") for f in fields])
    made = merkle_manifest(docs, fields, id_col, claimed=other, **kw)
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
