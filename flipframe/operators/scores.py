"""Scores of a pair's candidates against its gold text, its seed and each other, a batch of pairs at a time.

The texts of a pair come as consecutive rows: seed, gold text, candidates by index.  They are cut into tokens
(``operators/tokens.py``), which become codes of their slice; grams, distances and lengths are NumPy over a slice of pairs.  Only numbers leave, so no
token, gram or text is shuffled or written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.operators.distance import batch_token_distances, bit_parallel_distance
from flipframe.operators.ngram import MAX_N, gram_stats
from flipframe.operators.tokens import char_classes, cut_texts
from flipframe.session import ship_package

SLICE_BYTES = 1 << 18  # of the texts of the pairs that are scored together; one longer pair is a slice of its own
KNOWN_PAIRS = 4096  # distances that a task remembers: revisions of one original have equal seeds and candidates
SEED, GOLD = 0, 1  # places of a pair's rows; its candidates follow
COUNTS = ["hyp_len", "ref_len", *[f"num{n}" for n in range(1, MAX_N + 1)], "near_len", *[f"own{n}" for n in range(1, MAX_N + 1)]]


def candidate_rows(pairs: DataFrame, keep: Sequence[str], lines: bool = True) -> DataFrame:
    """(keep.., nth, idx, generated, text): the rows of each pair, in order; ``pairs`` has example,
    counterfactual and ``cands``, an array of (idx, generated) sorted by idx.  Texts are cut into lines and tokens where
    they are scored, whatever ``lines``."""
    other = lambda col: F.array(F.struct(F.lit(-1).alias("idx"), F.col(col).alias("generated")))
    texts = F.concat(other("example"), other("counterfactual"), F.col("cands").cast("array<struct<idx:int,generated:string>>"))
    rows = pairs.select(*keep, F.posexplode(texts).alias("nth", "t"))
    text = F.col("t.generated")
    return rows.select(*keep, "nth", F.col("t.idx").alias("idx"), F.when(F.col("nth") > GOLD, text).alias("generated"), text.alias("text"))


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)])


def _tree_distance(a: list[np.ndarray], b: list[np.ndarray], dot: int, out: list, todo: list) -> None:
    """Distances of aligned lines: settled ones to ``out``, the others to ``todo`` (see flat_tree_distance_rows)."""
    def padded(x: np.ndarray) -> int:  # against (ROOT (S (. .)))
        return 3 if not len(x) else 2 * len(x) + (0 if (x == dot).any() else 1)

    for k in range(max(len(a), len(b))):
        if k >= len(a) or k >= len(b):
            out.append(padded(b[k] if k >= len(a) else a[k]))
        elif len(a[k]) == len(b[k]) and (a[k] == b[k]).all():
            out.append(0)
        else:
            todo.append((a[k], b[k]))
            out.append(None)


def _marks(lens: list[np.ndarray], flat: pa.Array, ends: np.ndarray, at: np.ndarray):
    """A function from a row to the SHA-256 of its text's lines of tokens."""
    _, bounds, data = flat.cast(pa.binary()).buffers()
    bounds = np.frombuffer(bounds, np.int32, len(flat) + 1, 4 * flat.offset) if bounds else np.zeros(1, np.int32)
    data, sizes = memoryview(data or b""), np.diff(bounds)
    return lambda r: hashlib.sha256(b"".join((data[bounds[ends[r]] : bounds[ends[r + 1]]], sizes[ends[r] : ends[r + 1]].tobytes(),
                                              lens[1][at[r] : at[r + 1]].tobytes()))).digest()


def _score(nth: np.ndarray, idx: np.ndarray, col: pa.Array, classes: np.ndarray, closeness: bool, trees: bool, known: dict) -> dict[str, np.ndarray | list]:
    n_lines, line_lens, flat = cut_texts(col, classes)
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    at, line_at = _starts(n_lines), _starts(line_lens)
    ends = line_at[at]  # tokens of row r: codes[ends[r]:ends[r + 1]]
    here = col.is_valid().to_numpy(zero_copy_only=False)
    group = np.cumsum(nth == SEED) - 1
    rows = np.flatnonzero(nth > GOLD)
    text = lambda r: codes[ends[r] : ends[r + 1]]
    # grams: the gold text before the candidates of its pair, as slot -1
    used = np.flatnonzero(nth >= GOLD)
    keep = np.repeat(nth >= GOLD, np.diff(ends))
    stats = gram_stats(group[used], np.where(nth[used] == GOLD, -1, idx[used]), np.diff(ends)[used], codes[keep], words)
    found = {c: [None] * len(rows) for c in COUNTS}
    first = np.zeros(len(nth), bool)
    place = np.searchsorted(rows, used[stats["entry"]])
    for c in COUNTS:
        for p, v in zip(place.tolist(), stats[c]):
            found[c][p] = v
    first[rows[place]] = True
    seed = np.flatnonzero(nth == SEED)[group[rows]]
    gold = np.flatnonzero(nth == GOLD)[group[rows]]
    size = lambda rs: [int(ends[r + 1] - ends[r]) if here[r] else None for r in rs]
    out = {"first": first[rows], "n_tokens": size(rows), "counter_size": size(gold), "n_seed": size(seed), **found}
    if not closeness:
        return out
    mark = _marks([n_lines, line_lens], flat, ends, at)
    marks = {int(r): mark(r) for r in {*seed.tolist(), *rows.tolist()} if here[r]}
    keys = [(marks[s], marks[r]) if here[s] and here[r] else None for s, r in zip(seed.tolist(), rows.tolist())]
    fresh = {k: (s, r) for k, s, r in zip(keys, seed.tolist(), rows.tolist()) if k and k not in known}
    got: dict = {None: (None, None, None)} | {k: known[k] for k in keys if k in known}
    dots = pc.index(coded.dictionary, ".").as_py() if words else -1
    sides = lambda r: [codes[line_at[k] : line_at[k + 1]] for k in range(at[r], at[r + 1])]
    lines, todo = {k: [] for k in fresh}, []
    for k, (s, r) in fresh.items():
        if trees:
            _tree_distance(sides(s), sides(r), dots, lines[k], todo)
    dear = iter(batch_token_distances([a for a, _ in todo], [b for _, b in todo], 2).tolist() if todo else ())
    for k, (s, r) in fresh.items():
        total = sum(d if d is not None else next(dear) for d in lines[k])
        got[k] = (bit_parallel_distance(text(s).tolist(), text(r).tolist()), total, len(lines[k]))
    if len(known) + len(fresh) > KNOWN_PAIRS:
        known.clear()
    known.update((k, got[k]) for k in fresh)
    # (sum, lines): candidates of one index are averaged over all their lines
    for j, c in enumerate(["lev", "tree_sum", "tree_lines"]):
        out[c] = [got[k][j] for k in keys]
    return out


def candidate_scores(rows: DataFrame, keep: Sequence[str], closeness: bool = False, trees: bool = False) -> DataFrame:
    """One row per candidate of :func:`candidate_rows` with its numbers.

    ``first`` marks one row of each (pair, idx), which holds the gram counts of that index: clipped matches
    with the gold text (``num``, ``ref_len``) and with the other candidates (``own``, and
    ``near_len``, the closest length among them).
    """
    keep = [*keep, "idx"]
    long = [*COUNTS, "n_tokens", "counter_size", "n_seed", *(["lev"] if closeness else []), *(["tree_sum", "tree_lines"] if trees else [])]
    spec = T.StructType([*rows.select(*keep).schema.fields, T.StructField("place", T.IntegerType()), T.StructField("first", T.BooleanType()),
                         *[T.StructField(c, T.LongType()) for c in long]])

    spark = rows.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast(char_classes(spark))

    def score(part: pa.RecordBatch, classes: np.ndarray, known: dict) -> pa.RecordBatch:
        nth = part.column("nth").to_numpy()
        idx = pc.fill_null(part.column("idx"), -1).to_numpy()
        got = _score(nth, idx, part.column("text"), classes, closeness, trees, known)
        where = pa.array(np.flatnonzero(nth > GOLD))
        cols = [part.column(c).take(where) for c in keep]
        place = pa.array((nth[nth > GOLD] - GOLD - 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([*cols, place, pa.array(got["first"], pa.bool_()), *[pa.array(got[c], pa.int64()) for c in long]], names=spec.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        classes = np.frombuffer(table.value, np.uint8)
        left = None  # the last pair of a batch may go on in the next one
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            begin = np.flatnonzero(batch.column("nth").to_numpy() == SEED)
            size = _starts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))[begin]
            lo = 0
            while lo < len(begin) - 1:
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SLICE_BYTES, side="right")) - 1)
                hi = min(hi, len(begin) - 1)
                yield score(batch.slice(begin[lo], begin[hi] - begin[lo]), classes, known)
                lo = hi
            left = batch.slice(begin[-1]) if len(begin) else None
        if left is not None and left.num_rows:
            yield score(left, classes, known)

    return rows.select(*keep, "nth", "text").mapInArrow(run, spec)
