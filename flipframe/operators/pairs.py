"""Pair tables: paired-review pivot, NLI first-match lookups, wide/long candidate reshaping.

All grouping is done with aggregates (partial, map-side combined) and equi-joins; no group is
ever collected into a list, so a paired id or a hypothesis holding a third of all rows is
handled by partial aggregation and AQE's skew-join splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipframe.functions.order import hash_key
from flipframe.functions.text import strip_html
from flipframe.session import scratch_table, shuffle_partitions


def encode_sentiment(col, positive: str = "Positive"):
    """'Positive' -> 1, anything else -> 0."""
    return (F.col(col) == positive).cast("int") if isinstance(col, str) else (col == positive).cast("int")


def encode_with_map(col, mapping: dict[str, int]):
    """String label -> class id through a literal map (label order is a classifier property)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col) if isinstance(col, str) else col]


def invert_label(col):
    return (1 - (F.col(col) if isinstance(col, str) else col)).cast("int")


def assign_counterfactual(df: DataFrame, pair_col: str, row_col: str, seed, flag_col: str = "is_counterfactual") -> DataFrame:
    """Within each pair, the first row of the seeded shuffle is the counterfactual (1), the others 0.

    Written as min-aggregate + join rather than a window, so a pair id with a huge number of
    rows is reduced map-side instead of being sorted inside one task.
    """
    keyed = df.withColumn("_hk", hash_key(seed, row_col))
    first = keyed.groupBy(pair_col).agg(F.min(F.struct("_hk", row_col)).alias("_first"))
    out = keyed.join(first, on=pair_col, how="inner")
    is_first = (F.col("_hk") == F.col("_first._hk")) & (F.col(row_col) == F.col(f"_first.{row_col}"))
    return out.withColumn(flag_col, is_first.cast("int")).drop("_hk", "_first")


def pivot_pairs(df: DataFrame, pair_col: str = "paired_id", text_col: str = "text", label_col: str = "sentiment",
                flag_col: str = "is_counterfactual", clean_html: bool = True) -> DataFrame:
    """Two rows per pair -> one (example, counterfactual) row; pairs of any other size are dropped.

    The sizes are a hash aggregate over numbers; the texts are filtered by it and meet in a join,
    so no text goes through an aggregate buffer.
    """
    sizes = df.groupBy(pair_col).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(flag_col)).alias("_ncf"))
    whole = sizes.filter((F.col("_n") == 2) & (F.col("_ncf") == 1)).select(pair_col)
    # an explicit count: stripping markup is CPU-heavy, so AQE must not gather small texts into one task;
    # both sides of the join reuse this exchange
    rows = df.join(whole, on=pair_col, how="left_semi").repartition(shuffle_partitions(df.sparkSession), pair_col)

    def side(flag: int, text: str, label: str) -> DataFrame:
        t = F.col(text_col)
        return rows.filter(F.col(flag_col) == flag).select(
            pair_col, (strip_html(t) if clean_html else t).alias(text), F.col(label_col).cast("int").alias(label))

    return (side(0, "example", "label_ex").join(side(1, "counterfactual", "label_counter"), on=pair_col)
            .select(pair_col, "example", "label_ex", "counterfactual", "label_counter"))


def pivot_seeded(df: DataFrame, row_col: str, seed, pair_col: str = "paired_id", text_col: str = "text", label_col: str = "sentiment",
                 clean_html: bool = True) -> DataFrame:
    """:func:`assign_counterfactual` and :func:`pivot_pairs` in one pass over the numbers.

    In a pair of two rows the first of the seeded shuffle is the counterfactual and the last the
    example, so one aggregate gives both row numbers and the size.  Texts are then found by row
    number (unique) and meet by pair in one exchange that both sides read.
    """
    keyed = df.select(pair_col, row_col, hash_key(seed, row_col).alias("_hk"))
    key = F.struct("_hk", row_col)
    per = keyed.groupBy(pair_col).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_cf"), F.max(key).alias("_ex")).filter(F.col("_n") == 2)
    sides = per.select(pair_col, F.explode(F.array(
        F.struct(F.col(f"_cf.{row_col}").alias("row"), F.lit(1).alias("flag")), F.struct(F.col(f"_ex.{row_col}").alias("row"), F.lit(0).alias("flag")))).alias("_s"))
    sides = sides.select(pair_col, F.col("_s.row").alias(row_col), F.col("_s.flag").alias("_flag"))
    # an explicit count, as in pivot_pairs
    rows = sides.join(df.select(row_col, text_col, label_col), row_col).repartition(shuffle_partitions(df.sparkSession), pair_col)

    def side(flag: int, text: str, label: str) -> DataFrame:
        t = F.col(text_col)
        return rows.filter(F.col("_flag") == flag).select(pair_col, (strip_html(t) if clean_html else t).alias(text), F.col(label_col).cast("int").alias(label))

    return (side(0, "example", "label_ex").join(side(1, "counterfactual", "label_counter"), on=pair_col)
            .select(pair_col, "example", "label_ex", "counterfactual", "label_counter"))


def first_match_lookup(original: DataFrame, key_col: str, order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """(_key, values): the values of the first original row (lowest ``order_col``) of each distinct ``key_col``,
    which is known by its SHA-256, so no key is shuffled.

    The first row of each key is found on the digest and the order number alone and written (a few
    bytes per key): Spark then knows its size, and few keys fetch their values without a shuffle of all rows.
    """
    keyed = original.select(F.sha2(F.col(key_col).cast("binary"), 256).alias("_key"), order_col, *value_cols)
    first = scratch_table(keyed.groupBy("_key").agg(F.min(order_col).alias(order_col)), "first-match")
    return first.join(keyed, ["_key", order_col]).select("_key", *value_cols)


def _match(revised: DataFrame, lookup: DataFrame, key_col: str, parts: int | None = None) -> DataFrame:
    """Revised rows with their lookup row, joined on the digest; ``parts`` keeps AQE from gathering them."""
    keyed = revised.withColumn("_key", F.sha2(F.col(key_col).cast("binary"), 256))
    if parts:
        keyed = keyed.repartition(parts, "_key")
    return keyed.join(lookup, on="_key").drop("_key")


def revised_premise_pairs(revised: DataFrame, original: DataFrame, order_col: str = "row_order", parts: int | None = None) -> DataFrame:
    """RP rows: revised premise + original hypothesis -> original premise and label by first match.

    ``revised``: counter_prem, original_hyp, counter_label (+ any id); ``original``: premise,
    hypothesis, label, ``order_col``.  Rows without a match are dropped (inner join).  For work that is
    CPU-heavy per row, ``parts`` deals the rows to so many tasks.
    """
    lookup = first_match_lookup(original, "hypothesis", order_col, ["premise", "label"])
    lookup = lookup.select("_key", F.col("premise").alias("original_prem"), F.col("label").alias("original_label"))
    out = _match(revised, lookup, "original_hyp", parts)
    return out.withColumn("task", F.lit("RP")).withColumn("counter_hyp", F.lit(""))


def revised_hypothesis_pairs(revised: DataFrame, original: DataFrame, order_col: str = "row_order", parts: int | None = None) -> DataFrame:
    """RH rows: original premise + revised hypothesis -> original hypothesis and label by first match."""
    lookup = first_match_lookup(original, "premise", order_col, ["hypothesis", "label"])
    lookup = lookup.select("_key", F.col("hypothesis").alias("original_hyp"), F.col("label").alias("original_label"))
    if parts:
        # one premise may have most of the rows, so they are dealt by their text; the lookup, written, is broadcast while small
        # and equal premises, whose originals are one, stay side by side
        revised = revised.repartition(parts, "counter_hyp").sortWithinPartitions("original_prem")
        lookup = scratch_table(lookup, "first-hypotheses")
    out = _match(revised, lookup, "original_prem")
    return out.withColumn("task", F.lit("RH")).withColumn("counter_prem", F.lit(""))


NLI_COLUMNS = ["original_label", "counter_label", "task", "original_prem", "counter_prem", "original_hyp", "counter_hyp"]


def nli_scoring_sides(generated_col: str = "generated"):
    """(premise, hypothesis) handed to an NLI scorer for a generated counter text."""
    prem = F.when(F.col("task") == "RP", F.col(generated_col)).otherwise(F.col("original_prem"))
    hyp = F.when(F.col("task") == "RH", F.col(generated_col)).otherwise(F.col("original_hyp"))
    return prem, hyp


def nli_original_text():
    return F.when(F.col("task") == "RP", F.col("original_prem")).otherwise(F.col("original_hyp"))


def nli_counter_side():
    return F.when(F.col("task") == "RH", F.col("counter_hyp")).otherwise(F.col("counter_prem"))


def nli_label_switch(revised: bool):
    """Score revised sides against ``counter_label`` or original sides against ``original_label``."""
    if revised:
        prem = F.when(F.col("task") == "RP", F.col("counter_prem")).otherwise(F.col("original_prem"))
        hyp = F.when(F.col("task") == "RH", F.col("counter_hyp")).otherwise(F.col("original_hyp"))
        return prem, hyp, F.col("counter_label")
    return F.col("original_prem"), F.col("original_hyp"), F.col("original_label")


def candidates_long(wide: DataFrame, id_cols: Sequence[str], n: int, prefix: str = "generated_counter_") -> DataFrame:
    """Wide ``generated_counter_0..n-1`` -> long ``(id..., idx, generated)``; nulls kept."""
    cols = [f"{prefix}{i}" for i in range(n)]
    renamed = wide.select(*id_cols, *[F.col(c).alias(str(i)) for i, c in enumerate(cols)])
    long = renamed.unpivot(list(id_cols), [str(i) for i in range(n)], "idx", "generated")
    return long.withColumn("idx", F.col("idx").cast("int"))


def candidates_wide(long: DataFrame, id_cols: Sequence[str], n: int, prefix: str = "generated_counter_") -> DataFrame:
    """Long -> wide with exactly ``n`` candidate columns (explicit pivot values: no extra job)."""
    piv = long.groupBy(*id_cols).pivot("idx", list(range(n))).agg(F.first("generated"))
    return piv.select(*id_cols, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(n)])

