"""Exact, reproducible ranks, samples, splits and folds.

Every operator here orders rows by ``md5(seed:id)`` (see ``functions.order``) and needs a
*global* position in that order.  A global position is computed without a single-partition
window, in two passes over the data:

1. rows are cut into order-preserving buckets (the first hex digits of the md5 key, so the
   buckets are uniform whatever the data); a partial aggregate counts rows per
   (group, bucket) -- a table with at most ``groups x 16**hex_chars`` rows;
2. a running sum over that small table gives each bucket's offset; the offsets are joined
   back (AQE broadcasts the table when its measured size is under the broadcast threshold)
   and a ``row_number`` inside each (group, bucket) window adds the local position.

The windows and joins are partitioned by (group, bucket), so a class holding a third of all rows
is spread over up to 65,536 buckets.  ``hex_chars`` sets the bucket count (16**hex_chars); 4 keeps
each bucket near 1.5 million rows at 10**11 rows.  Samples and splits rank only the rows of the
bucket that holds the cut: lower buckets are taken and higher ones left by their number alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.functions.order import hash_bucket, hash_key, uniform01
from flipframe.functions.util import as_col

DEFAULT_HEX_CHARS = 4


def ranked(df: DataFrame, order: Sequence[Column], bucket: Column, by: Sequence[str] = (),
           rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """Add a 0-based global position of each row in ``order`` within each ``by`` group.

    ``bucket`` must be non-decreasing along ``order``; ``order`` must be a total order
    (end it with a unique id) for the result to be deterministic.
    """
    by = list(by)
    d = df.withColumn("_bkt", bucket)
    counts = d.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, "_bkt",
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(Window.partitionBy(*by)).alias("_gsize"))
    d = d.join(offs, on=[*by, "_bkt"], how="inner")
    local = F.row_number().over(Window.partitionBy(*by, "_bkt").orderBy(*order))
    d = d.withColumn(rank_col, (F.col("_off") + local - 1).cast("long"))
    if size_col:
        d = d.withColumn(size_col, F.col("_gsize").cast("long"))
    return d.drop("_bkt", "_off", "_cnt", "_gsize")


def hash_rank(df: DataFrame, id_col: str, seed, by: Sequence[str] = (), rank_col: str = "rank",
              size_col: str | None = None, hex_chars: int = DEFAULT_HEX_CHARS, key: Column | None = None) -> DataFrame:
    """Position of each row in the seeded pseudo-random order (a reproducible shuffle)."""
    k = key if key is not None else hash_key(seed, id_col)
    d = df.withColumn("_hk", k)
    out = ranked(d, [F.col("_hk"), F.col(id_col)], hash_bucket("_hk", hex_chars), by, rank_col, size_col)
    return out.drop("_hk")


def value_rank(df: DataFrame, order_col: str, rank_col: str = "rank", n_parts: int | None = None) -> DataFrame:
    """Position of each row in ascending ``order_col`` (a unique key), 0-based (``positions``)."""
    from flipframe.operators.positions import global_position

    return global_position(df, [F.col(order_col)], rank_col, n_parts)


def row_numbering(df: DataFrame, order_col: str, out_col: str = "row_id") -> DataFrame:
    """0..n-1 in ``order_col`` order, computed with distributed offsets (no global window)."""
    return value_rank(df, order_col, rank_col=out_col)


def _target_count(size: Column, n: int | None, frac: float | None) -> Column:
    if (n is None) == (frac is None):
        raise ValueError("give exactly one of n / frac")
    if n is not None:
        return F.least(F.lit(int(n)), size)
    # pandas: round(frac * N), Python rounding is half-to-even
    return F.bround(size.cast("double") * F.lit(float(frac)), 0).cast("long")


def _limits(keyed: DataFrame, id_col: str, by: list[str], target, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (group, bucket) that holds any of the group's first ``target(size)`` rows.

    Buckets that lie wholly before the cut have a null ``_cut``; in the one bucket of each group
    that holds the cut, the rows are ranked and ``_cut`` is the (key, id) of the last row taken.
    No other row is ever sorted.
    """
    counts = keyed.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"), *[F.max(c).alias(c) for c in carry])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, "_bkt", "_cnt", *carry, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(group).alias("_size"))
    offs = offs.withColumn("_take", target(F.col("_size")) - F.col("_off")).filter(F.col("_take") > 0)
    edge = offs.filter(F.col("_take") < F.col("_cnt")).select(*by, "_bkt", "_take")
    nth = F.row_number().over(Window.partitionBy(*by, "_bkt").orderBy("_hk", id_col))
    cut = (keyed.select(*by, "_bkt", "_hk", id_col).join(edge, on=[*by, "_bkt"]).withColumn("_nth", nth)
           .filter(F.col("_nth") == F.col("_take")).select(*by, "_bkt", F.struct(F.col("_hk"), F.col(id_col)).alias("_cut")))
    return offs.select(*by, "_bkt", "_size").join(cut, on=[*by, "_bkt"], how="left").withColumn("_in", F.lit(True))


def _marked(df: DataFrame, id_col: str, seed, by: Sequence[str], target, how: str, carry: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_flag``: is the row among the first ``target(group size)`` of its group in the
    seeded order?  The rows meet the small limits table on (group, bucket)."""
    by = list(by)
    keyed = df.withColumn("_hk", hash_key(seed, id_col)).withColumn("_bkt", hash_bucket("_hk", DEFAULT_HEX_CHARS))
    lim = _limits(keyed, id_col, by, target, carry)
    taken = F.col("_in") & (F.col("_cut").isNull() | (F.struct(F.col("_hk"), F.col(id_col)) <= F.col("_cut")))
    return (keyed.join(lim, on=[*by, "_bkt"], how=how).withColumn("_flag", F.coalesce(taken, F.lit(False)))
            .drop("_hk", "_bkt", "_cut", "_in", "_size"))


def exact_sample(df: DataFrame, id_col: str, seed, n: int | None = None, frac: float | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` (or ``round(frac*N)``) rows per group, without replacement."""
    cols = df.columns
    d = _marked(df, id_col, seed, by, lambda size: _target_count(size, n, frac), "inner")
    return d.filter("_flag").select(*cols)


def mark_sample(df: DataFrame, id_col: str, seed, n: int | None = None, frac: float | None = None,
                by: Sequence[str] = (), flag_col: str = "in_sample") -> DataFrame:
    """Same rows as :func:`exact_sample`, kept as a boolean flag so the complement costs nothing."""
    cols = df.columns
    d = _marked(df, id_col, seed, by, lambda size: _target_count(size, n, frac), "left")
    return d.select(*cols, F.col("_flag").alias(flag_col))


def complement(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``sample`` (anti-join on identity)."""
    return df.join(sample.select(id_col), on=id_col, how="left_anti")


def seeded_shuffle(df: DataFrame, id_col: str, seed, rank_col: str = "rank") -> DataFrame:
    """Rows with their position in the seeded shuffle; order by ``rank_col`` to materialise it."""
    return hash_rank(df, id_col, seed, rank_col=rank_col)


def prefix_split(df: DataFrame, id_col: str, seed, train_frac: float = 0.9, split_col: str = "split") -> DataFrame:
    """Shuffle, then the first ``int(train_frac*N)`` rows are train, the rest test."""
    cols = df.columns
    d = _marked(df, id_col, seed, [], lambda size: F.floor(size.cast("double") * F.lit(train_frac)), "left")
    return d.select(*cols, F.when(F.col("_flag"), "train").otherwise("test").alias(split_col))


def train_val_split(df: DataFrame, id_col: str, seed, val_frac: float, split_col: str = "split") -> DataFrame:
    """``round(val_frac*N)`` rows of the seeded order are validation, the rest training."""
    d = mark_sample(df, id_col, seed, frac=val_frac, flag_col="_v")
    return d.withColumn(split_col, F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def split_train_val_test(df: DataFrame, id_col: str, seed, train_frac: float = 0.8, val_frac: float = 0.2,
                         split_col: str = "split") -> DataFrame:
    """Two-stage split: ``train_frac`` of all rows, then validation rescaled to the remainder.

    Stage 1 keeps ``round(train_frac*N)`` rows (the rest is test); stage 2 takes
    ``round(N*val_frac/|stage1| * |stage1|)`` of those in a second seeded order as validation.
    """
    cols = df.columns
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    d = _marked(df, id_col, seed, [], lambda size: _target_count(size, None, train_frac), "left").withColumnRenamed("_flag", "_in1")
    d = d.crossJoin(F.broadcast(total))  # one row

    def n_val(size: Column) -> Column:
        rescaled = F.col("_n").cast("double") * F.lit(val_frac) / size.cast("double")
        return F.when(F.col("_in1"), F.bround(size.cast("double") * rescaled, 0)).otherwise(0).cast("long")

    d = _marked(d, id_col, f"{seed}/val", ["_in1"], n_val, "left", carry=["_n"])
    split = F.when(F.col("_flag"), "val").when(F.col("_in1"), "train").otherwise("test")
    return d.select(*cols, split.alias(split_col))


def bernoulli_split(df: DataFrame, id_col: str, seed, p: float = 0.8, flag_col: str = "is_train") -> DataFrame:
    """Independent per-row coin with probability ``p`` (stable: a function of the row only)."""
    return df.withColumn(flag_col, uniform01(hash_key(seed, id_col)) < F.lit(p))


def poisson_thresholds(lam: float, tail: float = 1e-15) -> list[float]:
    """Cumulative Poisson(lam) probabilities P(K <= j), j = 0.. until the tail is negligible.

    Each probability is computed in log space, so large ``lam`` neither underflows nor is cut.
    """
    out, c, j = [], 0.0, 0
    while True:
        p = math.exp(j * math.log(lam) - lam - math.lgamma(j + 1)) if lam > 0 else float(j == 0)
        c += p
        out.append(c)
        if j > lam and (1.0 - c < tail or p < tail * tail):
            return out
        j += 1


def sample_with_replacement(df: DataFrame, id_col: str, seed, fraction: float) -> DataFrame:
    """Each row repeated K ~ Poisson(fraction) times, K drawn from the row's own hash.

    Same expected size as ``DataFrame.sample(True, fraction)`` but independent of partitioning;
    :func:`draw_with_replacement` has the exact size.
    """
    u = uniform01(hash_key(seed, id_col))
    steps = F.array(*[F.lit(c) for c in poisson_thresholds(fraction)])
    d = df.withColumn("_k", F.size(F.filter(steps, lambda c: u >= c))).filter(F.col("_k") > 0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def draw_with_replacement(df: DataFrame, id_col: str, seed, n: int | None = None, frac: float | None = None) -> DataFrame:
    """Exactly ``n`` (or ``round(frac*N)``) independent uniform draws of rows, numbered by ``draw``.

    Draw j takes the row at position ``floor(u_j * N)`` in id order, u_j being 52 hash bits of
    (seed, j).  Rows meet their draws on the position; a row drawn often is repeated as often.
    """
    from flipframe.operators.positions import global_position

    size = df.count()
    want = n if n is not None else int(round(frac * size))
    cols = df.columns
    u = F.conv(F.substring(hash_key(seed, "draw"), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    draws = df.sparkSession.range(want if size else 0).withColumnRenamed("id", "draw").withColumn("_pos", F.floor(u * F.lit(size)).cast("long"))
    return global_position(df, [F.col(id_col)], "_pos").join(draws, on="_pos").select(*cols, "draw")


def balanced_sample(df: DataFrame, id_col: str, label_col: str, seed, n_per_class: int) -> DataFrame:
    """Exactly ``n_per_class`` rows of every class (all of a smaller class)."""
    return exact_sample(df, id_col, seed, n=n_per_class, by=[label_col])


def balanced_split(df: DataFrame, id_col: str, label_col: str, seed, test_frac: float | None = None,
                   test_n: int | None = None, split_col: str = "split") -> DataFrame:
    """Per class, ``test_n`` rows or ``round(test_frac*N_class)`` rows are test, the rest train."""
    d = mark_sample(df, id_col, seed, n=test_n, frac=test_frac, by=[label_col], flag_col="_t")
    return d.withColumn(split_col, F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def balanced_nested_split(df: DataFrame, id_col: str, label_col: str, seed, n_per_class: int,
                          test_per_class: int, split_col: str = "split") -> DataFrame:
    """Balanced sample of ``n_per_class`` per class, then ``test_per_class`` of it per class as test."""
    data = balanced_sample(df, id_col, label_col, seed, n_per_class)
    d = mark_sample(data, id_col, f"{seed}/test", n=test_per_class, by=[label_col], flag_col="_t")
    return d.withColumn(split_col, F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def nested_samples(df: DataFrame, id_col: str, seed, n: int, m: int) -> DataFrame:
    """origin (n+m rows) > n_data (n rows) > seed (m rows), as membership flags on the origin rows.

    The nesting is drawn on ids alone; the other columns join the chosen rows once at the end.
    """
    ids = df.select(id_col)
    d = mark_sample(exact_sample(ids, id_col, seed, n=n + m), id_col, f"{seed}/n", n=n, flag_col="in_n")
    seeds = exact_sample(d.filter("in_n").select(id_col), id_col, f"{seed}/m", n=m)
    seeds = hash_rank(seeds, id_col, f"{seed}/m", rank_col="seed_pos")
    d = d.join(seeds, on=id_col, how="left").withColumn("in_seed", F.col("seed_pos").isNotNull())
    return df.join(d, on=id_col) if len(df.columns) > 1 else d


def seed_table(nested: DataFrame, text_col: str = "text", label_col: str = "labels",
               sentiment_col: str | None = "sentiment") -> DataFrame:
    """Seed rows of :func:`nested_samples` in the seed layout: inverted label, ``"None"`` counterfactual."""
    s = nested.filter("in_seed")
    cols = [F.col(text_col).alias("example"), F.col(label_col).cast("int").alias("label_ex")]
    if sentiment_col:
        cols.append(F.col(sentiment_col).alias("sentiment_ex"))
        cols.append(F.when(F.col(sentiment_col) == "negative", "positive").otherwise("negative").alias("sentiment_counter"))
    cols += [(1 - F.col(label_col)).cast("int").alias("label_counter"),
             F.col("seed_pos").alias("paired_id"),
             F.lit("None").alias("counterfactual")]
    return s.select(*cols)


def fold_of(rank: Column, n: Column, k: int) -> Column:
    """Contiguous K-fold cut: the first ``n % k`` folds get one extra row."""
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return F.when(rank < big, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - big) / q)).cast("int")


def kfold(df: DataFrame, id_col: str, seed, k: int = 5, val_frac: float = 0.15,
          fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """Shuffled K-fold with a validation sample from each fold's remainder.

    Output has K copies of the data: in copy ``f`` a row is ``test`` if it falls in fold f,
    else ``val`` for ``round(val_frac * |remainder|)`` rows of a second seeded order, else
    ``training``.  Fold sizes differ by at most one.
    """
    d = hash_rank(df, id_col, seed, rank_col="_r", size_col="_n")
    d = d.withColumn("_home", fold_of(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")
    d = d.withColumn(fold_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # one second order for all copies: the test rows form their own groups and take none
    d = d.withColumn("_rest", F.col("_home") != F.col(fold_col))
    cols = [c for c in d.columns if c not in ("_home", "_rest")]

    def n_val(size: Column) -> Column:
        return F.when(F.col("_rest"), _target_count(size, None, val_frac)).otherwise(F.lit(0).cast("long"))

    d = _marked(d, id_col, f"{seed}/val", [fold_col, "_rest"], n_val, "left")
    split = F.when(~F.col("_rest"), "test").when(F.col("_flag"), "val").otherwise("training")
    return d.select(*cols, split.alias(split_col))
