"""BLEU family over n-gram count tables (corpus BLEU, BLEU@n, sentence BLEU, self-BLEU).

Plan: candidate and reference token rows are stacked and repartitioned by pair id once (explicit
count); each text's 1..4-grams come from one ``explode`` of ``arrays_zip`` over the token array and
its shifted slices, joined with ``concat_ws`` (whole-stage codegen, O(length) per text).  Counting
is an aggregate, clipping a window over (id, n, gram) that holds one row per text of the pair, and
the sums per (id, idx) an aggregate: all three accept the partitioning by id, so no n-gram row is
shuffled and nothing is joined.  The result has ``num1..num4`` and the two lengths of each
(id, idx), from which every BLEU variant is a closed-form column expression -- one count table
serves corpus, sentence and BLEU@1..4 at once.

Smoothing is "method 1" (epsilon 0.1 for a zero numerator); the per-row denominator is
``max(1, len - n + 1)`` and the corpus score sums numerators and denominators over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.session import shuffle_partitions

MAX_N = 4
EPSILON = 0.1
UNIFORM_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
ONE_HOT_WEIGHTS = {1: (1.0, 0.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0, 0.0), 3: (0.0, 0.0, 1.0, 0.0), 4: (0.0, 0.0, 0.0, 1.0)}


def ngram_rows(df: DataFrame, key_cols: Sequence[str], tokens_col: str, max_n: int = MAX_N) -> DataFrame:
    """``(key..., n, g)``: one row per n-gram occurrence; a text without tokens gives one row with n = 0.

    The token array is zipped with its own shifted copies (``arrays_zip`` of slices: position i
    holds tokens i..i+max_n-1, nulls past the end), exploded once, and the 1..max_n-grams of each
    position are built with ``concat_ws`` -- all whole-stage-codegen expressions, O(length) work
    and memory per text.
    """
    t = F.col(tokens_col)
    size = F.size(t)
    shifted = [F.slice(t, k + 1, F.greatest(size - k, F.lit(0))).alias(f"t{k}") for k in range(max_n)]
    z = df.select(*key_cols, F.explode_outer(F.arrays_zip(*shifted)).alias("_z"))
    grams = []
    for n in range(1, max_n + 1):
        g = F.when(F.col(f"_z.t{n - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"_z.t{k}") for k in range(n)]))
        grams.append(F.struct(F.lit(n).alias("n"), g.alias("g")))
    ex = z.select(*key_cols, F.col("_z").isNull().alias("_none"), F.explode(F.array(*grams)).alias("_ng"))
    ex = ex.filter(F.col("_ng.g").isNotNull() | (F.col("_none") & (F.col("_ng.n") == 1)))
    return ex.select(*key_cols, F.when(F.col("_none"), 0).otherwise(F.col("_ng.n")).alias("n"), F.col("_ng.g").alias("g"))


def ngram_counts(df: DataFrame, key_cols: Sequence[str], tokens_col: str, max_n: int = MAX_N) -> DataFrame:
    """``(key..., n, g, c)``: how often each n-gram occurs in each keyed token list."""
    return ngram_rows(df, key_cols, tokens_col, max_n).groupBy(*key_cols, "n", "g").agg(F.count(F.lit(1)).alias("c"))


def match_table(hyp: DataFrame, ref: DataFrame, id_col: str = "id", idx_col: str = "idx",
                hyp_tokens: str = "hyp_tokens", ref_tokens: str = "ref_tokens", max_n: int = MAX_N) -> DataFrame:
    """One row per (id, idx): ``num1..num{max_n}`` clipped matches, ``hyp_len``, ``ref_len``.

    ``hyp``: (id, idx, hyp_tokens) -- one row per candidate; ``ref``: (id, ref_tokens) -- one
    row per id (the gold side).  Candidates whose id has no reference row are dropped.
    """
    texts = hyp.select(id_col, F.col(idx_col).cast("long").alias("_idx"), F.col(hyp_tokens).alias("_t")).unionByName(
        ref.select(id_col, F.lit(-1).cast("long").alias("_idx"), F.col(ref_tokens).alias("_t")))
    # the one shuffle: token rows, before they are exploded into about ten times as many n-grams
    texts = texts.repartition(shuffle_partitions(hyp.sparkSession), id_col)
    counts = ngram_counts(texts, [id_col, "_idx"], "_t", max_n)
    gram, pair = Window.partitionBy(id_col, "n", "g"), Window.partitionBy(id_col)
    is_ref = F.col("_idx") < 0
    seen = (counts.withColumn("_rc", F.max(F.when(is_ref, F.col("c"))).over(gram))
            .withColumn("_ref_len", F.sum(F.when(is_ref, F.when(F.col("n") == 1, F.col("c")).otherwise(0))).over(pair))
            .filter(~is_ref & F.col("_ref_len").isNotNull()))
    # least() skips nulls, so a gram that the reference lacks must not count
    nums = [F.sum(F.when((F.col("n") == n) & F.col("_rc").isNotNull(), F.least("c", "_rc")).otherwise(0)) for n in range(1, max_n + 1)]
    return seen.groupBy(id_col, F.col("_idx").cast("int").alias(idx_col)).agg(
        F.sum(F.when(F.col("n") == 1, F.col("c")).otherwise(0)).alias("hyp_len"), F.max("_ref_len").alias("ref_len"),
        *[v.alias(f"num{n}") for n, v in enumerate(nums, 1)])


def gram_stats(group: np.ndarray, idx: np.ndarray, lens: np.ndarray, codes: np.ndarray, words: int, max_n: int = MAX_N) -> dict:
    """The counts of :func:`match_table` and :func:`self_bleu_rows` for a slice of pairs, one element per (pair, idx).

    Texts lie one after the other in ``codes`` (token numbers below ``words``), sorted by (``group``, ``idx``); idx -1 is
    the gold text.  Texts of one (pair, idx) count as one.  A gram is numbered per pair by its shorter
    gram's number and its last token, so grams of any length are sorted as single integers.
    ``entry`` is the first text of each element.
    """
    changed = np.ones(len(group), bool)
    changed[1:] = (group[1:] != group[:-1]) | (idx[1:] != idx[:-1])
    slot, entry = np.cumsum(changed) - 1, np.flatnonzero(changed)
    gold, pair, slots = idx[entry] < 0, group[entry], len(entry)
    ends = np.repeat(np.cumsum(lens), lens)
    owner = np.repeat(slot, lens)
    total = np.bincount(owner, minlength=slots)
    num, own = (np.zeros((max_n, slots), np.int64) for _ in range(2))
    start, key = np.arange(len(codes)), np.repeat(group, lens) * words + codes
    rank = np.empty(len(codes), np.int64)
    for n in range(max_n):
        if n:
            start = start[ends[start] - start > n]
            key = rank[start] * words + codes[start + n]
        if not len(start):
            break
        key = key * slots + owner[start]  # equal grams lie in the order of their texts
        order = np.argsort(key)
        key, by = np.divmod(key[order], slots)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[start[order]] = np.cumsum(fresh) - 1
        runs = np.flatnonzero(fresh | np.concatenate([[True], by[1:] != by[:-1]]))
        c, by, gram = np.diff(np.append(runs, len(key))), by[runs], rank[start[order[runs]]]
        in_gold = np.zeros(gram[-1] + 1, np.int64)
        in_gold[gram[gold[by]]] = c[gold[by]]
        c, by, gram = c[~gold[by]], by[~gold[by]], gram[~gold[by]]
        if not len(c):
            continue
        num[n] = np.bincount(by, np.minimum(c, in_gold[gram]), slots)
        runs = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        wide = np.diff(np.append(runs, len(gram)))
        most = np.repeat(np.maximum.reduceat(c, runs), wide)
        alone = np.repeat(np.add.reduceat((c == most).astype(np.int64), runs), wide) == 1
        second = np.repeat(np.maximum.reduceat(np.where(c < most, c, 0), runs), wide)
        own[n] = np.bincount(by, np.where((c == most) & alone, second, c), slots)
    ref_len: list = [None] * slots
    near: list = [None] * slots
    bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if slots else []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        first = lo + int(gold[lo])
        sizes = total[first:hi].tolist()
        for k, size in enumerate(sizes):
            ref_len[first + k] = int(total[lo]) if first > lo else None
            near[first + k] = min(((abs(x - size), x) for j, x in enumerate(sizes) if j != k), default=(0, None))[1]
    made = np.flatnonzero(~gold)
    return {"entry": entry[made], "hyp_len": total[made].tolist(), "ref_len": [ref_len[k] for k in made], "near_len": [near[k] for k in made],
            **{f"num{n + 1}": num[n][made].tolist() for n in range(max_n)}, **{f"own{n + 1}": own[n][made].tolist() for n in range(max_n)}}


def den(hyp_len: Column, n: int) -> Column:
    """Per-row modified-precision denominator (floored at 1 per row)."""
    return F.greatest(hyp_len - F.lit(n - 1), F.lit(1))


def bleu_expr(nums: Sequence[Column], dens: Sequence[Column], hyp_len: Column, ref_len: Column,
              weights: Sequence[float] = UNIFORM_WEIGHTS) -> Column:
    """Closed-form smoothed BLEU from (already summed) numerators, denominators and lengths."""
    log_sum = F.lit(0.0)
    for w, num, d in zip(weights, nums, dens):
        if w == 0:
            continue
        p = F.when(num > 0, num.cast("double") / d).otherwise(F.lit(EPSILON) / d)
        log_sum = log_sum + F.lit(float(w)) * F.log(p)
    bp = (F.when(hyp_len > ref_len, F.lit(1.0))
          .when(hyp_len == 0, F.lit(0.0))
          .otherwise(F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len)))
    return F.when(nums[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(log_sum))


def sentence_bleu_col(weights: Sequence[float] = UNIFORM_WEIGHTS, max_n: int = MAX_N) -> Column:
    """Per-row BLEU over a :func:`match_table` row."""
    nums = [F.col(f"num{n}") for n in range(1, max_n + 1)]
    dens = [den(F.col("hyp_len"), n) for n in range(1, max_n + 1)]
    return bleu_expr(nums, dens, F.col("hyp_len"), F.col("ref_len"), weights)


def self_bleu_col(weights: Sequence[float] = UNIFORM_WEIGHTS, max_n: int = MAX_N) -> Column:
    """Per-row BLEU of a candidate against the others of its id, over the counts of :func:`gram_stats`; null if alone."""
    nums, dens = [F.col(f"own{n}") for n in range(1, max_n + 1)], [den(F.col("hyp_len"), n) for n in range(1, max_n + 1)]
    return F.when(F.col("near_len").isNotNull(), bleu_expr(nums, dens, F.col("hyp_len"), F.col("near_len"), weights))


def corpus_bleu_by_idx(matches: DataFrame, idx_col: str = "idx", weights_by_name: dict | None = None,
                       max_n: int = MAX_N) -> DataFrame:
    """Corpus BLEU of every candidate index (sums over ids), one column per weighting."""
    weights_by_name = weights_by_name or {"bleu": UNIFORM_WEIGHTS}
    sums = matches.groupBy(idx_col).agg(
        *[F.sum(f"num{n}").alias(f"snum{n}") for n in range(1, max_n + 1)],
        *[F.sum(den(F.col("hyp_len"), n)).alias(f"sden{n}") for n in range(1, max_n + 1)],
        F.sum("hyp_len").alias("shyp"), F.sum("ref_len").alias("sref"))
    nums = [F.col(f"snum{n}") for n in range(1, max_n + 1)]
    dens = [F.col(f"sden{n}") for n in range(1, max_n + 1)]
    return sums.select(idx_col, *[bleu_expr(nums, dens, F.col("shyp"), F.col("sref"), w).alias(name)
                                  for name, w in weights_by_name.items()])


def bleu_weightings(prefix: str = "bleu") -> dict[str, tuple]:
    """Uniform 4-gram BLEU plus BLEU@1..4: five weightings served by one count table."""
    out = {prefix: UNIFORM_WEIGHTS}
    out.update({f"{prefix}_at_{n}": w for n, w in ONE_HOT_WEIGHTS.items()})
    return out


def self_bleu_rows(cands: DataFrame, id_col: str = "id", idx_col: str = "idx", tokens_col: str = "tokens",
                   weights: Sequence[float] = UNIFORM_WEIGHTS, max_n: int = MAX_N) -> DataFrame:
    """Self-BLEU per id: each candidate scored against all the others of its id, then averaged.

    Multi-reference clipping takes the max count over the other candidates; the reference
    length is the other candidate length closest to the hypothesis length (ties: shorter).
    The per-(id, n, gram) window holds at most N rows (one per candidate), so it is bounded.
    """
    # every later grouping key starts with the id: one shuffle, explicit count (CPU-heavy stage)
    cands = cands.repartition(shuffle_partitions(cands.sparkSession), id_col)
    hc = ngram_counts(cands, [id_col, idx_col], tokens_col, max_n)
    w = Window.partitionBy(id_col, "n", "g")
    hc = (hc.withColumn("_max1", F.max("c").over(w))
          .withColumn("_nmax", F.sum(F.when(F.col("c") == F.col("_max1"), 1).otherwise(0)).over(w))
          .withColumn("_max2", F.max(F.when(F.col("c") < F.col("_max1"), F.col("c"))).over(w)))
    others = F.when((F.col("c") == F.col("_max1")) & (F.col("_nmax") == 1),
                    F.coalesce(F.col("_max2"), F.lit(0))).otherwise(F.col("_max1"))
    rows = (hc.withColumn("_clip", F.least(F.col("c"), others))
            .groupBy(id_col, idx_col)
            .agg(F.sum(F.when(F.col("n") == 1, F.col("c")).otherwise(0)).alias("hyp_len"),
                 *[F.sum(F.when(F.col("n") == n, F.col("_clip")).otherwise(0)).alias(f"num{n}") for n in range(1, max_n + 1)]))
    # the N lengths of an id as one bounded list, to pick the closest other length
    lens = F.collect_list(F.struct(F.col(idx_col).alias("i"), F.col("hyp_len").alias("l"))).over(Window.partitionBy(id_col))
    t = rows.withColumn("_lens", lens)
    closest = F.array_min(F.transform(
        F.filter(F.col("_lens"), lambda x: x["i"] != F.col(idx_col)),
        lambda x: F.struct(F.abs(x["l"] - F.col("hyp_len")).alias("d"), x["l"].alias("l"))))
    t = t.withColumn("ref_len", closest["l"])
    t = t.withColumn("_score", F.when(F.col("ref_len").isNotNull(), sentence_bleu_col(weights, max_n)))
    return t.groupBy(id_col).agg(F.avg("_score").alias("self_bleu"))
