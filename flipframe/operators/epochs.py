"""Text classifier trained in epochs, with early stopping and the best epoch kept.

A softmax regression over the words of a text.  The model is a table with one row per
(feature, label): weight and the two moments of the optimiser (Adam with decoupled weight decay).
A step is three aggregates: scores are sums over the features of a document, residuals join back
to its features, and gradients are sums over the documents of a feature.  The features are dealt to lots once
(:class:`_Lots`), and a full batch's scores serve both its loss and its step.  Nothing but one
accuracy per epoch reaches the driver, and the vocabulary has no limit.

After each epoch the validation accuracy is taken; training ends after ``patience`` epochs without
a better one, and the weights of the best epoch (the earliest of equals) are kept.  Documents are
dealt to batches by a hash of their id, so neither order nor cluster size changes the result.

A text's features are its words, weighted 1 + ln(count) and scaled to length 1, and a constant
one named by the empty string.  Texts without words, null texts included, have only that one; rows with a null label are
not trained on.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens
from flipframe.operators.bayes import MAX_CLASSES
from flipframe.session import bucketed_table, scratch_table, shuffle_partitions

BETA1, BETA2 = 0.9, 0.999  # decay of the moments


@dataclass(frozen=True)
class Settings:
    rate: float = 0.1
    decay: float = 0.0
    epsilon: float = 1e-8
    max_epochs: int = 6
    patience: int = 2
    batches: int = 1  # steps of an epoch


def document_features(df: DataFrame, id_col: str, text_col: str = "text", label_col: str | None = "labels") -> DataFrame:
    """(id, label, features): an array of (feature, x) per document, written once."""
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col).cast("int")
    # dealt by id once, as texts: the groups and the join below keep to that dealing
    dealt = df.select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = dealt.repartition(shuffle_partitions(df.sparkSession), "id").select("id", "label", word_tokens("text").alias("t"))
    words = docs.select("id", F.explode("t").alias("feature")).groupBy("id", "feature").agg((1 + F.log(F.count(F.lit(1)))).alias("x"))
    bags = words.groupBy("id").agg(F.collect_list(F.struct("feature", "x")).alias("f"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    constant = F.array(F.struct(F.lit("").alias("feature"), F.lit(1.0).alias("x")))
    scaled = F.transform("f", lambda e: F.struct(e["feature"].alias("feature"), (e["x"] / F.col("norm")).alias("x")))
    out = docs.select("id", "label").join(bags, "id", "left").select("id", "label", F.concat(constant, F.coalesce(scaled, F.array().cast(
        "array<struct<feature:string,x:double>>"))).alias("features"))
    return scratch_table(out, "features")


def label_values(features: DataFrame) -> list[int]:
    """The labels in order; their number is checked, as they become columns of every document."""
    got = [r.label for r in features.where(F.col("label").isNotNull()).select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
    if len(got) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return got


def class_scores(features: DataFrame, weights: DataFrame, labels: Sequence[int]) -> DataFrame:
    """(id, label, scores): the score of each label, in the order of ``labels``.  A document none of whose
    features the model knows scores 0 for all."""
    rows = features.select("id", F.explode("features").alias("e")).select("id", F.col("e.feature").alias("feature"), F.col("e.x").alias("x"))
    known = rows.join(weights.select("feature", "w"), "feature")  # w: one weight per label
    sums = [F.sum(F.col("x") * F.get("w", k)) for k in range(len(labels))]
    per = known.groupBy("id").agg(F.array(*sums).alias("scores"))
    zero = F.array(*[F.lit(0.0)] * len(labels))
    return features.select("id", "label").join(per, "id", "left").select("id", "label", F.coalesce("scores", zero).alias("scores"))


def probabilities(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def best_label(scores: Column, labels: Sequence[int]) -> Column:
    """The label of the highest score, of equals the smallest."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


@contextmanager
def _joined_in_lots(spark: SparkSession):
    """Joins on a lot and another key take tables dealt by lot alone as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class _Lots:
    """Documents dealt by id to lots, for many passes over their features.

    ``entries`` (lot, id, feature, x) and ``docs`` (lot, id, label) are bucketed by lot and never shuffled
    again.  A pass sends each lot the weights of its own features, one row per feature and lot (``words``), and
    gets back one partial gradient per feature and lot.
    """

    def __init__(self, features: DataFrame):
        spark = features.sparkSession
        self.n = shuffle_partitions(spark)
        lot = F.pmod(F.xxhash64(F.lit("lot"), "id"), F.lit(4 * self.n)).cast("int").alias("lot")
        tag = uuid.uuid4().hex[:12]
        rows = features.select(lot, "id", F.explode("features").alias("e")).select("lot", "id", F.col("e.feature").alias("feature"), F.col("e.x").alias("x"))
        self.entries = bucketed_table(spark, f"entries_{tag}", lambda: rows, "lot")
        self.docs = bucketed_table(spark, f"documents_{tag}", lambda: features.select(lot, "id", "label"), "lot")
        self.words = bucketed_table(spark, f"words_{tag}", lambda: self.entries.select("lot", "feature").distinct(), "feature")

    def scores(self, weights: DataFrame, labels: Sequence[int], where: Column) -> DataFrame:
        """(lot, id, label, scores) as :func:`class_scores` has them."""
        own = self.words.join(weights.select("feature", "w"), "feature").repartition(self.n, "lot")
        known = self.entries.where(where).join(own.hint("shuffle_hash"), ["lot", "feature"])
        sums = [F.sum(F.col("x") * F.get("w", k)) for k in range(len(labels))]
        per = known.groupBy("lot", "id").agg(F.array(*sums).alias("scores"))
        zero = F.array(*[F.lit(0.0)] * len(labels))
        return self.docs.where(where).join(per, ["lot", "id"], "left").select("lot", "id", "label", F.coalesce("scores", zero).alias("scores"))

    def gradient(self, residuals: DataFrame, n_labels: int) -> DataFrame:
        """(feature, g): sums over the documents of ``residuals`` (lot, id, r)."""
        near = residuals.repartition(self.n, "lot").hint("shuffle_hash")
        sums = [F.sum(F.col("x") * F.get("r", k)) for k in range(n_labels)]
        return self.entries.join(near, ["lot", "id"]).groupBy("feature").agg(F.array(*sums).alias("g"))


def _step(lots: _Lots, p: DataFrame, weights: DataFrame, labels: Sequence[int], step: int, s: Settings) -> DataFrame:
    """Weights after one gradient step on the documents of ``p`` (lot, id, label, p)."""
    n_labels = len(labels)
    names = F.array(*[F.lit(v) for v in labels])
    residual = F.zip_with("p", names, lambda q, y: q - F.when(y == F.col("label"), 1.0).otherwise(0.0))
    n = p.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    grad = lots.gradient(p.select("lot", "id", residual.alias("r")), n_labels)
    grad = grad.crossJoin(F.broadcast(n)).select("feature", F.transform("g", lambda v: v / F.col("n")).alias("g"))
    both = weights.join(grad, "feature", "full")
    zero = F.array(*[F.lit(0.0)] * n_labels)
    w, m, v, g = (F.coalesce(c, zero) for c in ("w", "m", "v", "g"))
    m1 = F.zip_with(m, g, lambda a, b: BETA1 * a + (1 - BETA1) * b)
    v1 = F.zip_with(v, g, lambda a, b: BETA2 * a + (1 - BETA2) * b * b)
    moved = both.select("feature", w.alias("w"), m1.alias("m"), v1.alias("v"))
    c1, c2 = 1 - BETA1**step, 1 - BETA2**step
    move = F.zip_with("m", "v", lambda a, b: (a / c1) / (F.sqrt(b / c2) + s.epsilon))
    new = F.zip_with("w", move, lambda a, b: a - s.rate * (b + s.decay * a))
    return moved.select("feature", new.alias("w"), "m", "v")


def train(train_set: DataFrame, val_set: DataFrame, settings: Settings, seed="epochs") -> tuple[DataFrame, list[dict], list[int]]:
    """Train on :func:`document_features` tables.

    Returns the best epoch's weights (feature, w per label, m, v), the epochs as a list of epoch, loss (mean
    negative log-likelihood of the training set before the epoch's first step), accuracy and best, and the labels.
    """
    spark = train_set.sparkSession
    rows = train_set.where(F.col("label").isNotNull())
    labels = label_values(rows)
    weights = spark.createDataFrame([], "feature string, w array<double>, m array<double>, v array<double>")
    epochs, best, kept, step = [], None, weights, 0
    if not labels:
        return weights, epochs, labels
    bucket = F.pmod(F.xxhash64(F.lit(str(seed)), "id"), F.lit(settings.batches))
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int")
    lots, val = _Lots(rows), _Lots(val_set)
    everywhere = F.lit(True)

    def predicted(where: Column) -> DataFrame:
        got = lots.scores(weights, labels, where).withColumn("p", probabilities(F.col("scores")))
        return scratch_table(got.select("lot", "id", "label", "p"), "probabilities")

    with _joined_in_lots(spark):
        for epoch in range(1, settings.max_epochs + 1):
            p = predicted(everywhere)  # the loss and, of a single batch, the step read them
            loss = p.agg(F.avg(-F.log(F.element_at("p", position)))).first()[0]
            for b in range(settings.batches):
                step += 1
                batch = p if settings.batches == 1 else predicted(bucket == b) if b else p.where(bucket == b)
                weights = scratch_table(_step(lots, batch, weights, labels, step, settings), f"weights-{step}")
            guess = val.scores(weights, labels, everywhere).select((best_label(F.col("scores"), labels) == F.col("label")).cast("double").alias("hit"))
            accuracy = guess.agg(F.avg("hit")).first()[0] or 0.0
            epochs.append({"epoch": epoch, "loss": loss, "accuracy": accuracy})
            if best is None or accuracy > epochs[best - 1]["accuracy"]:
                best, kept = epoch, weights
            if epoch - best >= settings.patience:
                break
    for e in epochs:
        e["best"] = e["epoch"] == best
    return kept, epochs, labels


def predict(weights: DataFrame, labels: Sequence[int], features: DataFrame) -> DataFrame:
    """(id, pred) for :func:`document_features` rows."""
    return class_scores(features, weights, labels).select("id", best_label(F.col("scores"), labels).alias("pred"))
