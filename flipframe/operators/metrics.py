"""Table-level aggregates: distributions, two-level means/variances, label flip, precision/
recall/F1, leaderboards, contingency tables, correlations, McNemar tests, perplexity.

Everything is a partial (map-side combined) aggregate; tail probabilities are expressions on the
aggregated row (``functions/tails.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.functions.tails import binomial_half_log10_two_sided, chi2_1df_sf


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, length_col: str) -> DataFrame:
    c = F.col(length_col)
    return df.agg(F.max(c).cast("long").alias("max_len"), F.avg(c).alias("mean_len"), F.min(c).cast("long").alias("min_len"),
                  F.count(F.lit(1)).alias("n_rows"))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(f(col).alias("n_distinct"))


def mean_var(df: DataFrame, score_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance (ddof 0) of a per-row score."""
    return df.groupBy(*by).agg(F.avg(score_col).alias("mean"), F.var_pop(score_col).alias("var"))


def two_level_mean_var(df: DataFrame, score_col: str, idx_col: str = "idx", prefix: str = "") -> DataFrame:
    """Per candidate index: mean and variance over rows; then the mean of the means and the
    variance of the per-candidate variances (0 whenever there is a single candidate)."""
    per = df.groupBy(idx_col).agg(F.avg(score_col).alias("_m"), F.var_pop(score_col).alias("_v"))
    return per.agg(F.avg("_m").alias(f"{prefix}mean"), F.var_pop("_v").alias(f"{prefix}var"))


def label_flip_rate(pred: DataFrame, target_col: str, pred_col: str = "pred", idx_col: str = "idx") -> DataFrame:
    """Accuracy of predictions against the desired (flipped) label, per candidate, averaged."""
    hit = (F.col(pred_col) == F.col(target_col)).cast("double")
    per = pred.groupBy(idx_col).agg(F.avg(hit).alias("_acc"))
    return per.agg(F.avg("_acc").alias("label_flip"))


def mean_confidence(pred: DataFrame, score_col: str = "score", idx_col: str = "idx") -> DataFrame:
    per = pred.groupBy(idx_col).agg(F.avg(score_col).alias("_c"))
    return per.agg(F.avg("_c").alias("confidence"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_prf(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 with class 1 positive; 0 on an empty denominator."""
    y, p = F.col(label_col), F.col(pred_col)
    agg = df.groupBy(*by).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                              F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return agg.select(*by, _safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                      rec.alias("recall"), _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def micro_prf(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Micro-averaged precision/recall/F1/accuracy for single-label multi-class predictions.

    Pooled over classes every wrong prediction is one FP (for the predicted class) and one FN
    (for the true class), so the four numbers coincide; they are still computed from counts.
    """
    hit = F.col(label_col) == F.col(pred_col)
    agg = df.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("miss"))
    tp, miss = F.col("tp"), F.col("miss")
    prec = _safe_div(tp, tp + miss)
    rec = _safe_div(tp, tp + miss)
    return agg.select(*by, _safe_div(tp, tp + miss).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                      _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def leaderboard(preds: DataFrame, model_col: str = "model", label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """One metric row per model over a long (model, id, label, pred) table."""
    return micro_prf(preds, label_col, pred_col, by=[model_col])


def contingency(df: DataFrame, label_col: str, pred_a: str, pred_b: str) -> DataFrame:
    """2x2 table of two classifiers: both correct, only A, only B, both wrong."""
    ca = F.col(pred_a) == F.col(label_col)
    cb = F.col(pred_b) == F.col(label_col)
    return df.agg(F.count_if(ca & cb).alias("cc"), F.count_if(ca & ~cb).alias("ci"),
                  F.count_if(~ca & cb).alias("ic"), F.count_if(~ca & ~cb).alias("ii"))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for every (a, b) cell plus both margins and the total (``cube``: nulls mark margins)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic (|b-c| - 1)^2 / (b+c)."""
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c))


def mcnemar(table: DataFrame, alphas: Sequence[float] = (0.05, 0.01)) -> DataFrame:
    """Exact and chi-square McNemar tests on a :func:`contingency` row."""
    b, c = F.col("ci"), F.col("ic")
    out = table.select("*", binomial_half_log10_two_sided(b, c).alias("log10_p_exact"), mcnemar_chi2(b, c).alias("chi2"))
    out = out.withColumn("p_exact", F.pow(F.lit(10.0), F.col("log10_p_exact"))).withColumn("p_chi2", chi2_1df_sf(F.col("chi2")))
    for a in alphas:
        out = out.withColumn(f"significant_{str(a).replace('0.', '')}", F.col("p_chi2") < F.lit(a))
    return out


def pearson_by(df: DataFrame, x: str, y: str, by: Sequence[str] = ("idx",)) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("pearson"))


def mid_ranks(df: DataFrame, value_col: str, by: Sequence[str], out_col: str) -> DataFrame:
    """Average rank (1-based, ties share the mean rank) of ``value_col`` within ``by``.

    Distinct values are counted per group, range-partitioned on (group, value) -- any double, at
    any scale, falls in a partition of about equal size -- and the counts of smaller values come
    from ``positions.running_totals``; the ranks join back on (group, value).
    """
    from flipframe.operators.positions import in_ranges, running_totals

    by = list(by)
    vals = df.groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    ranged = in_ranges(vals, [*by, value_col])
    vals = running_totals(ranged, [value_col], F.col("_cnt"), "_before", by)
    vals = vals.select(*by, value_col, (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(out_col))
    return df.join(vals, on=[*by, value_col], how="left")


def spearman_by(df: DataFrame, x: str, y: str, by: Sequence[str] = ("idx",), materialise: bool = True) -> DataFrame:
    """Spearman correlation per group: Pearson over mid-ranks of x and y.

    The ranking reads its input several times (distinct values, join back), so the needed columns
    are written once to the shared scratch folder first.
    """
    d = df.select(*by, x, y).na.drop(subset=[x, y])  # complete cases only, as for Pearson
    if materialise:
        from flipframe.session import scratch_table

        d = scratch_table(d, "spearman")
    d = mid_ranks(d, x, by, "_rx")
    d = mid_ranks(d, y, by, "_ry")
    return d.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def perplexity(token_losses: DataFrame, batch_col: str = "batch", loss_col: str = "nll", weight_col: str | None = None) -> DataFrame:
    """exp(mean over batches of the batch-mean token loss); a row stands for ``weight_col`` tokens."""
    mean = weighted_mean(loss_col, weight_col) if weight_col else F.avg(loss_col)
    per = token_losses.groupBy(batch_col).agg(mean.alias("_bm"))
    return per.agg(F.exp(F.avg("_bm")).alias("perplexity"), F.avg("_bm").alias("eval_loss"))


def running_loss(log: DataFrame, step_col: str = "step", loss_col: str = "loss", logging_steps: int = 8) -> DataFrame:
    """Average loss per logging interval: the value reported at each log point."""
    return (log.groupBy(F.floor(F.col(step_col) / logging_steps).cast("long").alias("log_point"))
            .agg(F.avg(loss_col).alias("avg_loss"), F.count(F.lit(1)).alias("n_steps")))
