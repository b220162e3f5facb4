"""Multinomial naive Bayes on word counts: a text classifier that is aggregates and one join.

All smoothing settings are scored in one pass over the texts: a sweep costs one job, and the best
setting is the one with the highest validation accuracy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.functions.text import word_tokens
from flipframe.session import scratch_table


def settings_grid(alphas: Sequence[float], priors: Sequence[bool] = (True,)) -> list[dict]:
    """Every combination, numbered in order."""
    return [{"setting": k, "alpha": float(a), "prior": p} for k, (a, p) in enumerate((a, p) for a in alphas for p in priors)]


def random_settings(grid: Sequence[dict], k: int, seed) -> list[dict]:
    """``k`` settings of the grid, the first in the md5 order of ``seed:number`` (as samples are drawn)."""
    import hashlib

    order = sorted(grid, key=lambda s: hashlib.md5(f"{seed}:{s['setting']}".encode()).hexdigest())
    return sorted(order[:k], key=lambda s: s["setting"])


def train_counts(train: DataFrame, text_col: str = "text", label_col: str = "labels") -> dict[str, DataFrame]:
    """Word counts by class, class totals with prior, vocabulary size: all a setting needs."""
    rows = train.select(F.col(label_col).cast("int").alias("label"), F.explode(word_tokens(text_col)).alias("token"))
    words = scratch_table(rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")), "bayes-words")
    docs = train.groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    total = train.agg(F.count(F.lit(1)).alias("all_docs"))
    classes = words.groupBy("label").agg(F.sum("c").alias("tokens")).join(docs, "label").crossJoin(F.broadcast(total))  # one row
    classes = classes.crossJoin(F.broadcast(words.agg(F.countDistinct("token").alias("v"))))  # one row
    return {"words": words, "classes": scratch_table(classes, "bayes-classes")}


def predict(model: dict[str, DataFrame], texts: DataFrame, settings: Sequence[dict], id_col: str, text_col: str = "text") -> DataFrame:
    """(id, setting, pred) for every text and setting; of equally likely classes the smallest.

    The log-likelihood of a class is n * ln(alpha / (tokens + alpha v)) plus, for the text's words
    that the class knows, count * ln((c + alpha) / alpha): only known words are joined.
    """
    opts = F.array(*[F.struct(F.lit(s["setting"]).alias("setting"), F.lit(s["alpha"]).alias("alpha"), F.lit(s["prior"]).alias("prior")) for s in settings])
    toks = texts.select(id_col, word_tokens(text_col).alias("t"))
    words = toks.select(id_col, F.explode("t").alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    gains = [F.sum(F.col("n") * F.log((F.col("c") + s["alpha"]) / s["alpha"])).alias(f"g{s['setting']}") for s in settings]
    known = words.join(model["words"], "token").groupBy(id_col, "label").agg(*gains)
    # one row per class of the training table
    base = toks.select(id_col, F.size("t").alias("n")).crossJoin(F.broadcast(_checked_small(model["classes"])))
    full = base.join(known, on=[id_col, "label"], how="left")
    gain = F.element_at(F.array(*[F.coalesce(f"g{s['setting']}", F.lit(0.0)) for s in settings]), F.col("_k") + 1)
    full = full.select("*", F.posexplode(opts).alias("_k", "o"))
    a = F.col("o.alpha")
    prior = F.when(F.col("o.prior"), F.log(F.col("docs") / F.col("all_docs"))).otherwise(0.0)
    score = prior + F.col("n") * F.log(a / (F.col("tokens") + a * F.col("v"))) + gain
    best = full.groupBy(id_col, F.col("o.setting").alias("setting")).agg(F.max(F.struct(score.alias("s"), (-F.col("label")).alias("l"))).alias("m"))
    return best.select(id_col, "setting", (-F.col("m.l")).cast("int").alias("pred"))


MAX_CLASSES = 10_000


def _checked_small(classes: DataFrame) -> DataFrame:
    """The class table, whose row count is checked before it is broadcast."""
    if classes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return classes


def sweep(train: DataFrame, val: DataFrame, settings: Sequence[dict], id_col: str, text_col: str = "text", label_col: str = "labels") -> DataFrame:
    """(setting, alpha, prior, accuracy, best): validation accuracy of every setting; the best is the
    most accurate, ties to the smallest number."""
    p = predict(train_counts(train, text_col, label_col), val, settings, id_col, text_col)
    acc = p.join(val.select(id_col, F.col(label_col).cast("int").alias("_y")), id_col).groupBy("setting").agg(
        F.avg((F.col("pred") == F.col("_y")).cast("double")).alias("accuracy"))
    schema = T.StructType([T.StructField("setting", T.IntegerType()), T.StructField("alpha", T.DoubleType()), T.StructField("prior", T.BooleanType())])
    named = train.sparkSession.createDataFrame([(s["setting"], s["alpha"], s["prior"]) for s in settings], schema)
    out = scratch_table(named.join(acc, "setting"), "sweep")
    top = out.agg(F.max(F.struct("accuracy", (-F.col("setting")).alias("s"))).alias("m"))
    return out.crossJoin(F.broadcast(top)).select("setting", "alpha", "prior", "accuracy", (F.col("setting") == -F.col("m.s")).alias("best"))


def best_predictions(train: DataFrame, val: DataFrame, test: DataFrame, settings: Sequence[dict], id_col: str,
                     text_col: str = "text", label_col: str = "labels") -> DataFrame:
    """(id, setting, pred) of the setting chosen on ``val``, fitted on ``train``, for ``test``."""
    chosen = sweep(train, val, settings, id_col, text_col, label_col).filter("best").select("setting")
    p = predict(train_counts(train, text_col, label_col), test, settings, id_col, text_col)
    return p.join(F.broadcast(chosen), "setting")  # one row
