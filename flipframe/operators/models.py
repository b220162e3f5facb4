"""Model-backed operators: batch scoring, pair scoring, candidate generation, classifier
training and sweeps.

Models are plug-ins.  A *scorer* is either
  * a rule made of Column expressions (runs in the JVM; used by the tests and the SQL oracle), or
  * a ``make_predict_fn`` factory run through ``predict_batch_udf`` / an iterator ``pandas_udf``,
    so a real model is loaded once per Python worker and fed Arrow batches.
A *generator* is a ``generate_fn(pandas.DataFrame) -> list[list[str]]`` called from
``mapInPandas`` on batches of prompts; a failing row yields N nulls, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.functions.text import TOKEN_PATTERN, truncate_for_scoring, word_tokens
from flipframe.functions.util import as_col

# --- rule scorers (deterministic stand-ins for classifiers, SQL-expressible) --------------


def parity_scorer(text) -> tuple[Column, Column]:
    """(label, score): label = token count of the scored text mod 2; score in [0.5, 1)."""
    t = truncate_for_scoring(as_col(text))
    label = (F.size(word_tokens(t)) % 2).cast("int")
    score = F.lit(0.5) + (F.length(t) % 50) / F.lit(100.0)
    return label, score


def first_letter_scorer(text) -> tuple[Column, Column]:
    """(label, score): label 1 when the text starts with a vowel (case-insensitive)."""
    t = truncate_for_scoring(as_col(text))
    label = F.lower(F.substring(t, 1, 1)).isin("a", "e", "i", "o", "u").cast("int")
    score = F.lit(0.5) + (F.length(t) % 30) / F.lit(100.0)
    return label, score


def joint_count_class(premise_tokens: Column, hypothesis_tokens: Column) -> Column:
    """Class id of :func:`nli_rule_scorer` from the sides' token counts."""
    return ((premise_tokens + hypothesis_tokens) % 3).cast("int")


def nli_rule_scorer(premise, hypothesis) -> Column:
    """Class id in {0, 1, 2} from the joint token count (stand-in for an NLI cross-encoder)."""
    return joint_count_class(F.size(word_tokens(as_col(premise))), F.size(word_tokens(as_col(hypothesis))))


nli_rule_scorer.on_counts = joint_count_class  # for callers that have counted the tokens of the sides


def score_texts(df: DataFrame, text_col: str, scorer=parity_scorer, label_col: str = "pred",
                score_col: str = "score") -> DataFrame:
    """M1 with a rule scorer: adds (pred, score) to every row."""
    label, score = scorer(F.col(text_col))
    return df.withColumn(label_col, label).withColumn(score_col, score)


def score_texts_udf(df: DataFrame, text_col: str, make_predict_fn: Callable, batch_size: int = 64,
                    label_col: str = "pred", score_col: str = "score") -> DataFrame:
    """M1 with a model: ``make_predict_fn()`` -> fn(np.ndarray[str]) -> dict(label=..., score=...)."""
    from pyspark.ml.functions import predict_batch_udf

    rtype = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("score", T.DoubleType())])
    udf = predict_batch_udf(make_predict_fn, return_type=rtype, batch_size=batch_size)
    t = truncate_for_scoring(F.col(text_col))
    out = df.withColumn("_r", udf(t))
    return out.withColumn(label_col, F.col("_r.label")).withColumn(score_col, F.col("_r.score")).drop("_r")


def make_parity_model():
    """A NumPy "model" with the parity rule of :func:`parity_scorer`, for the ``predict_batch_udf``
    path (loaded once per Python worker, called on Arrow batches of already-truncated texts)."""
    import numpy as np
    import regex

    # same classes as TOKEN_PATTERN, with Java's (ASCII) whitespace spelled out
    pat = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]")

    def predict(texts):
        n_tok = np.array([len(pat.findall(t)) for t in texts], dtype=np.int64)
        n_chr = np.array([len(t) for t in texts], dtype=np.int64)
        return {"label": (n_tok % 2).astype(np.int32), "score": 0.5 + (n_chr % 50) / 100.0}

    return predict


def score_pairs(df: DataFrame, premise: Column, hypothesis: Column, scorer=nli_rule_scorer, pred_col: str = "pred") -> DataFrame:
    """M2 with a rule scorer: arg-max class id of a (premise, hypothesis) pair."""
    return df.withColumn(pred_col, scorer(premise, hypothesis))


def score_pairs_udf(df: DataFrame, premise: Column, hypothesis: Column, make_predict_fn: Callable, batch_size: int = 64,
                    pred_col: str = "pred") -> DataFrame:
    """M2 with a model: ``make_predict_fn()`` -> fn(premises, hypotheses) -> scores, an array of one row
    per pair and one column per class; the prediction is the class of the highest score."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    scores = udf(F.coalesce(premise, F.lit("")), F.coalesce(hypothesis, F.lit("")))
    out = df.withColumn("_scores", scores)
    return out.withColumn(pred_col, (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int")).drop("_scores")


def make_joint_count_model():
    """A NumPy pair "model" whose logits rank the class of :func:`nli_rule_scorer` first, for the
    ``predict_batch_udf`` path (loaded once per Python worker, called on Arrow batches)."""
    import numpy as np
    import regex

    pat = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]")

    def predict(premises, hypotheses):
        n = np.array([len(pat.findall(p)) + len(pat.findall(h)) for p, h in zip(premises, hypotheses)], dtype=np.int64)
        return -((np.arange(3)[None, :] - n[:, None]) % 3).astype(np.float32)

    return predict


def map_labels(label_names: Column, label_map: dict[str, int]) -> Column:
    """Classifier label name -> class id (the order is a property of each classifier)."""
    m = F.create_map(*[x for k, v in label_map.items() for x in (F.lit(k), F.lit(v))])
    return m[label_names]


# --- generation ---------------------------------------------------------------------------


def toy_generate(pdf: pd.DataFrame, n: int) -> list[list[str | None]]:
    """Deterministic stand-in generator: the seed's words rotated by 1..n, cut to the budget."""
    out = []
    for prompt, example, budget in zip(pdf["prompt"], pdf["example"], pdf["max_length"]):
        words = (example or "").split(" ")
        cands = []
        for i in range(1, n + 1):
            k = i % max(len(words), 1)
            cands.append(" ".join((words[k:] + words[:k])[: int(budget)]))
        out.append(cands)
    return out


SLICE_ROWS, SLICE_BYTES = 256, 4 << 20  # of the prompts a generator holds at once; one longer row is a slice of its own


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that keep to the bounds above."""
    size = np.full(batch.num_rows, 16, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def generate_candidates(prompts: DataFrame, generate_fn: Callable[[pd.DataFrame, int], list], n: int,
                        keep_cols: Sequence[str]) -> DataFrame:
    """M3: batches of prompts -> N candidates per row (ARRAY<STRING>); a failing row gets N nulls
    and its error text, the job carries on.  A worker holds the texts of one slice of a batch at a time."""
    keep = list(keep_cols)
    schema = T.StructType([*prompts.select(*keep).schema.fields, T.StructField("generated", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                pdf = part.to_pandas()
                gens, errs = [], []
                try:
                    gens = list(generate_fn(pdf, n))
                    errs = [None] * len(pdf)
                except Exception:  # fall back to row by row so one bad row does not sink the batch
                    gens = []
                    for i in range(len(pdf)):
                        try:
                            gens.append(list(generate_fn(pdf.iloc[i:i + 1], n))[0])
                            errs.append(None)
                        except Exception as e:  # noqa: BLE001 - recorded per row
                            gens.append([None] * n)
                            errs.append(repr(e))
                made = [pa.array(gens, pa.list_(pa.string())), pa.array(errs, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, "generated", "error"])

    return prompts.mapInArrow(run, schema)


def explode_generated(gen: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    return gen.select(*id_cols, F.posexplode("generated").alias("idx", "generated"))


def with_settings(df: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """Attach each of a small, fixed list of settings to every row (explode of a literal array,
    no join): the rows of a generation sweep, one job for all settings."""
    keys = sorted({k for s in settings for k in s})
    arr = F.array(*[F.struct(*[F.lit(s.get(k)).alias(k) for k in keys]) for s in settings])
    return df.withColumn("setting", F.explode(arr))


# --- classifier training (MLlib) ----------------------------------------------------------


def text_classifier(num_features: int = 1 << 18, reg_param: float = 0.0, max_iter: int = 50):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol="text", outputCol="_words", pattern=TOKEN_PATTERN, gaps=False, toLowercase=False)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    lr = LogisticRegression(labelCol="labels", featuresCol="features", regParam=reg_param, maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr]), lr, tf


def train_classifier(train: DataFrame, reg_param: float = 0.0, max_iter: int = 50):
    pipe, _, _ = text_classifier(reg_param=reg_param, max_iter=max_iter)
    return pipe.fit(train.select("text", F.col("labels").cast("double").alias("labels")))


def sweep_classifier(train: DataFrame, val: DataFrame, settings: Sequence[dict]):
    """M5 with MLlib: one fit per setting (reg_param, max_iter) on ``train``, accuracy on ``val``.

    Both tables come from a hash split, so the chosen setting doesn't depend on the cluster.
    Returns [(setting, accuracy)] and the model of the best (ties: the first).
    """
    scored, best = [], None
    for s in settings:
        model = train_classifier(train, **s)
        acc = predict(model, val).agg(F.avg((F.col("pred") == F.col("labels")).cast("double"))).first()[0]
        if best is None or acc > max(a for _, a in scored):
            best = model
        scored.append((s, acc))
    return scored, best


def predict(model, df: DataFrame, pred_col: str = "pred") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(pred_col, F.col("prediction").cast("int")).drop(
        "_words", "_tf", "features", "rawPrediction", "probability", "prediction")
