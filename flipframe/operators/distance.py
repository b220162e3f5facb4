"""Token edit distance (T5) and sentence-aligned tree edit distance.

Token edit distance stays inside the JVM: each token becomes one character (a code point, UTF-32
encoded), and Spark's built-in ``levenshtein`` (code-point based) runs on the two encoded strings.
Only tokens that both sides hold need codes of their own; the others can match nothing and share
one code per side.

The distance of two one-level trees (a root over tagged tokens) is a token edit distance in which a
token costs two nodes to insert or delete and one to change, so aligned sentences are compared as token
arrays, a batch of pairs at a time.  Nested trees need Zhang-Shasha, which no SQL engine has: the
distinct (tree, tree) pairs are computed once in ``mapInPandas`` and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.session import shuffle_partitions

# Token codes are code points from CODE_BASE upward, skipping the surrogate block, written as
# UTF-32 so every token is exactly one character for ``levenshtein``.
CODE_BASE = 0x1000
SURROGATE_START, SURROGATE_SIZE = 0xD800, 0x800
MAX_CODE_POINT = 0x10FFFF
MAX_SHARED_TOKENS = MAX_CODE_POINT - CODE_BASE - SURROGATE_SIZE + 1


def _encode(tokens: Column, shared: Column, alone: str) -> Column:
    def one(t):
        at = F.array_position(shared, t)
        code = F.lit(CODE_BASE - 1) + at
        code = F.when(code >= SURROGATE_START, code + SURROGATE_SIZE).otherwise(code)
        return F.when(at == 0, alone).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    return F.array_join(F.transform(tokens, one), "")


def token_edit_distance_native(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Unit-cost insert/delete/substitute distance between two token arrays (JVM only).

    ``shared`` should be a column holding ``array_intersect(a, b)`` computed once per row: an
    expression passed here would be re-evaluated inside the per-token lambda.  More than
    MAX_SHARED_TOKENS distinct shared tokens (about 1.1 million, a table of 10**12 cells) raise an
    error; :func:`token_edit_distance_udf` has no such bound.
    """
    shared = shared if shared is not None else F.array_intersect(a, b)
    distance = F.levenshtein(_encode(a, shared, "a"), _encode(b, shared, "b")).cast("long")
    return F.when(F.size(shared) > MAX_SHARED_TOKENS, F.raise_error("too many distinct tokens for one pair").cast("long")).otherwise(distance)


def _lev_np(a: list, b: list) -> int:
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    vocab = {t: i for i, t in enumerate(set(a) | set(b))}
    bb = np.fromiter((vocab[t] for t in b), dtype=np.int64, count=len(b))
    prev = np.arange(len(b) + 1, dtype=np.int64)
    offs = np.arange(len(b) + 1, dtype=np.int64)
    for i, t in enumerate(a, start=1):
        code = vocab[t]
        cur = np.empty_like(prev)
        cur[0] = i
        sub = prev[:-1] + (bb != code)
        dele = prev[1:] + 1
        cur[1:] = np.minimum(sub, dele)
        # insertions: cur[j] = min(cur[j], cur[j-1] + 1) as a running minimum
        cur = np.minimum.accumulate(cur - offs) + offs
        prev = cur
    return int(prev[-1])


def bit_parallel_distance(a: list, b: list) -> int:
    """Unit-cost edit distance with a row of the table as bits of two integers (Myers, Hyyro): a step per token of ``b``."""
    if not a or not b:
        return len(a) or len(b)
    where: dict = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # where the column rises and falls by one
    for t in b:
        eq = where.get(t, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(level | up)), up & level
        distance += bool(right & last) - bool(left & last)
        right = right << 1 & full | 1
        up, down = (left << 1 & full) | (full & ~(eq | down | right)), right & (eq | down)
    return distance


@F.pandas_udf(T.LongType())
def token_edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if (x is None or y is None) else _lev_np(list(x), list(y)) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int64")


def with_token_edit_distance(df: DataFrame, a_col: str, b_col: str, out_col: str = "distance") -> DataFrame:
    """Add the token edit distance of two array columns (null where either is null): one narrow
    pass, no job of its own."""
    # the shared tokens are found once per row (a hash intersection) and then referenced by the lambda
    with_v = df.withColumn("_shared", F.array_intersect(F.col(a_col), F.col(b_col)))
    return with_v.withColumn(out_col, token_edit_distance_native(F.col(a_col), F.col(b_col), F.col("_shared"))).drop("_shared")


def normalised_distance(distance: Column, seed_tokens: Column) -> Column:
    """Distance divided by the seed's token count; null for an empty seed."""
    n = F.size(seed_tokens)
    return F.when(n > 0, distance.cast("double") / n)


# --- trees -------------------------------------------------------------------------------
# fixed value: the parse of a lone "." used to pad the shorter sentence list
PAD_TREE = "(ROOT (S (. .)))"


def parse_bracketed(s: str):
    """'(A (B b) c)' -> ('A', [('B', [('b', [])]), ('c', [])]).  Trees of any depth: no recursion."""
    toks = s.replace("(", " ( ").replace(")", " ) ").split()
    root: tuple[str, list] = ("", [])
    top, open_ = [], []
    fresh = False  # the next plain token labels the node just opened
    for t in toks:
        if t == "(":
            if fresh:
                open_[-1] = ("", open_[-1][1])
            open_.append(("", []))
            fresh = True
        elif t == ")":
            if not open_:
                continue
            done = open_.pop()
            (open_[-1][1] if open_ else top).append(done)
            fresh = False
        elif fresh:
            open_[-1] = (t, open_[-1][1])
            fresh = False
        else:
            (open_[-1][1] if open_ else top).append((t, []))
    while open_:
        done = open_.pop()
        (open_[-1][1] if open_ else top).append(done)
    return top[0] if top else root


def _postorder(tree):
    """Labels, leftmost leaf and number of children of each node in post-order."""
    labels, lmd, kids = [], [], []
    stack = [(tree, 0, None)]
    while stack:
        (label, children), at, first = stack.pop()
        if at < len(children):
            stack.append(((label, children), at + 1, len(labels) if first is None else first))
            stack.append((children[at], 0, None))
            continue
        labels.append(label)
        lmd.append(len(labels) - 1 if first is None else first)
        kids.append(len(children))
    return labels, lmd, kids


TREE_TASKS = 4  # tasks of a tree comparison per shuffle partition
SMALL_TREE = 8  # nodes up to which a subtree's distances are computed when needed, not stored
CHUNK = 128  # small subtrees computed together


class _Tree:
    def __init__(self, tree, code: dict[str, int]):
        labels, lmd, kids = _postorder(tree)
        self.code = np.array([code.setdefault(t, len(code)) for t in labels])
        self.lmd, self.leaf = np.array(lmd), np.array(kids) == 0
        self.size = np.arange(len(labels)) - self.lmd + 1
        last = {v: i for i, v in enumerate(lmd)}
        self.roots = [i for i in sorted(last.values()) if not self.leaf[i]]  # inner key roots

    def shape(self, x: int) -> tuple:
        return tuple((self.lmd[self.lmd[x] : x + 1] - self.lmd[x]).tolist())


class _TreePair:
    """Zhang-Shasha over vectors.

    A row of distances runs over all subtrees of ``b``. Where a leaf is involved the distance has a
    closed form: keep one node, with the leaf's label if the other subtree has it. Inner subtrees
    of ``a`` up to SMALL_TREE nodes get their rows in chunks, just before a larger forest reads
    them; rows are stored for larger ones only, so memory grows with their number, not with the
    product of both sizes. Forest tables against all subtrees of ``b`` of one shape are filled
    together, and keep a row only while a later one refers to it.
    """

    def __init__(self, a, b):
        code: dict[str, int] = {}
        self.a, self.b = _Tree(a, code), _Tree(b, code)
        shapes: dict[tuple, list[int]] = {}
        for j in self.b.roots:
            shapes.setdefault(self.b.shape(j), []).append(j)
        self.classes = []  # nested subtrees first
        for shape, js in sorted(shapes.items(), key=lambda kv: len(kv[0])):
            back, m = np.array(shape), len(shape)
            ys = np.array(js)[:, None] - (m - 1) + np.arange(m)
            whole = np.flatnonzero(back == 0)
            self.classes.append((back, ys, whole, whole[~self.b.leaf[ys[0][whole]]]))

    def leaf_rows(self, xs: np.ndarray) -> np.ndarray:
        """Distances of leaves of a to all subtrees of b."""
        met = np.cumsum(self.b.code[None, :] == self.a.code[xs][:, None], axis=1)
        before = np.where(self.b.lmd > 0, met[:, self.b.lmd - 1], 0)
        return self.b.size - (met > before)

    def forest(self, li: np.ndarray, lmd: np.ndarray, row_of, on_path) -> None:
        """Forest tables of equally shaped subtrees of a (first nodes ``li``, leftmost leaves ``lmd``
        as offsets) against all of b; ``row_of(p)`` has the distances of the subtrees at offset p.
        Distances of whole trees go to ``on_path(p)``, a row array or None."""
        n, b = len(lmd), self.b
        last_use = {int(v): r + 1 for r, v in enumerate(lmd)}
        ended: dict[int, list[int]] = {}
        for k, r in last_use.items():
            ended.setdefault(r, []).append(k)
        for back, ys, whole, fill in self.classes:
            m = len(back)
            step = np.arange(m + 1)
            prev = np.broadcast_to(step, (len(li), len(ys), m + 1))
            rows = {0: prev}
            for p in range(n):
                match = rows[int(lmd[p])][:, :, back] + row_of(p)[:, ys]
                if lmd[p] == 0:  # where both forests are whole trees the roots are relabelled
                    match[:, :, whole] = prev[:, :, whole] + (b.code[ys[:, whole]][None] != self.a.code[li + p][:, None, None])
                row = np.empty((len(li), len(ys), m + 1), np.int64)
                row[:, :, 0] = p + 1
                np.minimum(prev[:, :, 1:] + 1, match, out=row[:, :, 1:])
                row -= step
                np.minimum.accumulate(row, axis=2, out=row)
                row += step
                if lmd[p] == 0 and (to := on_path(p)) is not None:
                    to[:, ys[:, fill]] = row[:, :, fill + 1]
                if last_use.get(p + 1, 0) > p + 1:
                    rows[p + 1] = row
                for k in ended.get(p + 1, ()):
                    rows.pop(k, None)
                prev = row

    def against_leaves(self, xs: np.ndarray) -> np.ndarray:
        """Rows for inner nodes of a with the closed form at the leaves of b, zero elsewhere."""
        out = np.zeros((len(xs), len(self.b.code)), np.int64)
        at = np.flatnonzero(self.b.leaf)
        if len(xs) == 1:
            x = int(xs[0])
            out[0, at] = self.a.size[x] - np.isin(self.b.code[at], self.a.code[self.a.lmd[x] : x + 1])
            return out
        size = int(self.a.size[xs[0]])  # many subtrees are of equal shape
        has = np.zeros((len(xs), len(at)), bool)
        for k in range(size):
            has |= self.b.code[at][None, :] == self.a.code[xs - k][:, None]
        out[:, at] = size - has
        return out

    def small_rows(self, xs: np.ndarray) -> np.ndarray:
        """Rows of equally shaped small inner subtrees, their own inner subtrees first."""
        a, size = self.a, int(self.a.size[xs[0]])
        first = xs - size + 1
        rel = a.lmd[first[0] : xs[0] + 1] - first[0]
        done: dict[int, np.ndarray] = {}
        for p in range(size):
            nodes = first + p
            if a.leaf[nodes[0]]:
                done[p] = self.leaf_rows(nodes)
                continue
            out = self.against_leaves(nodes)
            begin, lmd = int(rel[p]), rel[rel[p] : p + 1] - rel[p]
            self.forest(first + begin, lmd, lambda q: done[begin + q] if begin + q in done else out, lambda q: out if begin + q == p else None)
            done[p] = out
        return done[size - 1]

    def distance(self) -> int:
        a, b = self.a, self.b
        top = len(a.code) - 1
        if a.leaf[top]:
            return int(self.leaf_rows(np.array([top]))[0, -1])
        if a.size[top] <= SMALL_TREE:
            return int(self.small_rows(np.array([top]))[0, -1])
        small = np.flatnonzero(a.size <= SMALL_TREE)
        large = np.flatnonzero(a.size > SMALL_TREE)
        stored = {int(x): r[None].copy() for x in large.tolist() for r in self.against_leaves(np.array([x]))}
        soon: dict[int, np.ndarray] = {}

        def row_at(x: int) -> np.ndarray:
            if x in stored:
                return stored[x]
            if x not in soon:
                soon.clear()
                at = int(np.searchsorted(small, x))
                groups: dict[tuple, list[int]] = {}
                for y in small[at : at + CHUNK].tolist():
                    groups.setdefault(a.shape(y), []).append(y)
                for shape, ys in groups.items():
                    some = np.array(ys)
                    for y, r in zip(ys, self.leaf_rows(some) if len(shape) == 1 else self.small_rows(some)):
                        soon[y] = r[None]
            return soon[x]

        for i in a.roots:
            if a.size[i] > SMALL_TREE:
                li = int(a.lmd[i])
                self.forest(np.array([li]), a.lmd[li : i + 1] - li, lambda p: row_at(li + p), lambda p: stored.get(li + p))
        return int(stored[top][0, -1])


def tree_edit_distance(a, b) -> int:
    """Zhang-Shasha distance with unit insert/remove and 0/1 relabel cost (:class:`_TreePair`)."""
    return _TreePair(a, b).distance()


def _tree_pairs_udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        d = [tree_edit_distance(parse_bracketed(a), parse_bracketed(b)) for a, b in zip(pdf["t_ref"], pdf["t_gen"])]
        yield pdf.assign(tree_distance=pd.Series(d, dtype="int64"))[["_key", "tree_distance"]]


def tree_distance_rows(trees: DataFrame, id_cols=("paired_id", "idx"), ref_col: str = "ref_trees",
                       gen_col: str = "gen_trees", pad_tree: str = PAD_TREE) -> DataFrame:
    """Mean sentence-aligned tree edit distance per row; the shorter list is padded with ``pad_tree``.

    Both lists are in one row, so they are zipped (a missing tree is null) and exploded, not
    joined.  Equal pairs of trees are compared once; a pair is known by its SHA-256, so the trees
    themselves are shuffled only to drop repeated pairs.
    """
    ids = list(id_cols)
    zipped = F.arrays_zip(F.col(ref_col).alias("r"), F.col(gen_col).alias("g"))
    aligned = trees.select(*ids, F.explode(zipped).alias("_z"))
    aligned = aligned.select(*ids, F.coalesce("_z.r", F.lit(pad_tree)).alias("t_ref"), F.coalesce("_z.g", F.lit(pad_tree)).alias("t_gen"))
    aligned = aligned.withColumn("_key", F.sha2(F.concat_ws("\n", "t_ref", "t_gen").cast("binary"), 256))
    # an explicit count: a pair's cost is the product of its sizes, so AQE must not gather small texts into few tasks
    pairs = aligned.select("_key", "t_ref", "t_gen").repartition(TREE_TASKS * shuffle_partitions(trees.sparkSession), "_key").dropDuplicates(["_key"])
    scored = pairs.mapInPandas(_tree_pairs_udf, "_key string, tree_distance long")
    return (aligned.select(*ids, "_key").join(scored, on="_key")
            .groupBy(*ids).agg(F.avg("tree_distance").alias("tree_distance")))


FLAT_CELLS = 1 << 20  # cells of a step over a group of pairs


def batch_token_distances(a: list[np.ndarray], b: list[np.ndarray], indel: int) -> np.ndarray:
    """Edit distances of pairs of code arrays (change 1, insert or delete ``indel``): pairs of like size
    advance together, one token of ``a`` at a time."""
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((lb, la))
    longest = np.maximum(la, lb) + 1
    lo = 0
    while lo < len(order):
        hi, top = lo, 0
        while hi < len(order) and (hi == lo or max(top, longest[order[hi]]) * (hi - lo + 1) <= FLAT_CELLS):
            top = max(top, longest[order[hi]])
            hi += 1
        g = order[lo:hi]
        lo, wide = hi, lb[g].max() + 1
        left, right = np.full((len(g), la[g].max()), -1), np.full((len(g), wide - 1), -2)
        for k, p in enumerate(g):
            left[k, : la[p]], right[k, : lb[p]] = a[p], b[p]
        slope = indel * np.arange(wide)
        row = np.broadcast_to(slope, (len(g), wide)).copy()
        for i in range(left.shape[1] + 1):
            ends = np.nonzero(la[g] == i)[0]
            out[g[ends]] = row[ends, lb[g[ends]]]
            if i < left.shape[1]:
                nxt = np.empty_like(row)
                nxt[:, 0] = indel * (i + 1)
                nxt[:, 1:] = np.minimum(row[:, :-1] + (left[:, i : i + 1] != right), row[:, 1:] + indel)
                # insertions: a running minimum along the row
                row = np.minimum.accumulate(nxt - slope, axis=1) + slope
    return out


def flat_tree_distance_rows(rows: DataFrame, id_cols=("paired_id", "idx"), ref_col: str = "ref_lines", gen_col: str = "gen_lines") -> DataFrame:
    """Mean distance of aligned sentences per row, each a one-level tree over its tokens
    (``flat_tree``); a missing sentence is the padding tree of a lone "."

    ``ref_col`` and ``gen_col`` are arrays of token arrays.  Equal sentences and missing ones are
    settled by expressions; the others meet in Arrow batches.
    """
    ids = list(id_cols)
    z = F.arrays_zip(F.col(ref_col).alias("r"), F.col(gen_col).alias("g"))
    pairs = rows.select(*ids, F.explode(z).alias("z")).select(*ids, F.col("z.r").alias("a"), F.col("z.g").alias("b"))

    def padded(t: str) -> Column:  # against (ROOT (S (. .)))
        return F.when(F.size(t) == 0, 3).otherwise(2 * F.size(t) + F.when(F.array_contains(t, "."), 0).otherwise(1))

    easy = F.when(F.col("a").isNull(), padded("b")).when(F.col("b").isNull(), padded("a")).when(F.col("a") == F.col("b"), 0)
    pairs = pairs.withColumn("d", easy.cast("long"))
    spec = T.StructType([*rows.select(*ids).schema.fields, T.StructField("d", T.LongType())])

    def codes(col: pa.Array, book: dict) -> list[np.ndarray]:
        flat = col.flatten().dictionary_encode()
        at = np.array([book.setdefault(t, len(book)) for t in flat.dictionary.to_pylist()], np.int64)
        own = at[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        ends = np.cumsum([len(v) if v.is_valid else 0 for v in col])
        return np.split(own, ends[:-1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            book: dict = {}
            a, b = (codes(batch.column(len(ids) + k), book) for k in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(batch_token_distances(a, b, 2))], names=[*ids, "d"])

    hard = pairs.where(F.col("d").isNull()).select(*ids, "a", "b").mapInArrow(compare, spec)
    both = pairs.where(F.col("d").isNotNull()).select(*ids, "d").unionByName(hard)
    return both.groupBy(*ids).agg(F.avg("d").alias("tree_distance"))


def escape_tree_token(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-"))


def flat_tree(tokens: Column, root: str = "S", leaf: str = "T") -> Column:
    """A one-level bracketed tree over a token list: ``(S (T tok) (T tok) ...)``."""
    leaves = F.transform(tokens, lambda t: F.concat(F.lit(f"({leaf} "), escape_tree_token(t), F.lit(")")))
    return F.concat(F.lit(f"({root} "), F.array_join(leaves, " "), F.lit(")"))
