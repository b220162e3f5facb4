"""Quality classifier: a generalised additive model with pairwise interactions.

Per-feature lookup tables are learnt by cyclic boosting: each round visits every feature once
and fits a shallow tree to the log-loss gradient on that feature's histogram alone, adding the
tree's leaf values to the feature's table.  The strongest feature pairs, ranked by how much a
shallow two-feature tree lowers the remaining loss, get two-way tables in the same manner.  A text is scored by
looking up one bin per feature (and per pair) and adding.

Texts: null counts as empty; an empty text has all-zero features and still gets a score between
0 and 1.  Equal texts get equal scores.  A text of any length is read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import ready, scan_texts

FEATURES = (
    "log_bytes", "upper_share", "symbol_share", "comma_stop_share", "digit_share", "non_ascii_share",
    "blank_share", "mean_word_bytes", "distinct_share", "top_word_share", "repeat_next_share",
    "distinct_pair_share", "top_pair_share", "odd_end_share", "upper_word_share", "one_letter_share",
    "repeated_line_share", "log_words_per_line", "stop_per_word", "short_line_share",
)

#: The most labelled rows the model is fitted on, drawn by hash of doc_id.  More rows move the tables little; the bound
#: keeps the fit's memory (rows x features doubles) and time fixed while scoring covers every row.
SAMPLE_ROWS = 12_000

_UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(2))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD_END = frozenset(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'")


def features(text: bytes | None) -> list[float]:
    """The FEATURES of one text, from its whole UTF-8 bytes."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    freq = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    p = max(1, len(words) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return [
        float(np.log1p(n)),
        float(count[_UPPER].sum()) / letters,
        float(count[_SYMBOL].sum()) / n,
        float(count[44] + count[46]) / n,
        float(count[_DIGIT].sum()) / n,
        float(count[128:].sum()) / n,
        float(count[_BLANK].sum()) / n,
        sum(map(len, words)) / w,
        len(freq) / w,
        max(freq.values(), default=0) / w,
        sum(c for (a, b), c in pairs.items() if a == b) / p,
        len(pairs) / p,
        max(pairs.values(), default=0) / p,
        sum(c for x, c in freq.items() if x[-1] in _ODD_END) / w,
        sum(c for x, c in freq.items() if len(x) > 1 and x.isupper()) / w,
        sum(c for x, c in freq.items() if len(x) == 1) / w,
        1.0 - len(set(lines)) / k,
        float(np.log1p(len(words) / k)),
        float(count[46]) / w,
        sum(1 for x in lines if len(x) < 40) / k,
    ]


@dataclass
class GamModel:
    """Bin edges and additive log-odds tables."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of a feature matrix: one vectorised addition per table."""
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for j in {j for ab in self.pairs for j in ab}}
        for (a, b), t in zip(self.pairs, self.pair_tables):
            z += t[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-z))


def _edges(col: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1]))


def _cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Best cut of a histogram of gradients and curvatures: its gain and how many bins go left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if len(gl) == 0:
        return 0.0, 0
    gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float) -> np.ndarray:
    """Leaf value per bin of a depth-limited tree on one feature's histogram."""
    gain, at = _cut(g, h, lam) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, lam), _tree(g[at:], h[at:], depth - 1, lam)])


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature of a pair, then the other in each half: loss reduction and values."""
    best_gain, best = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, at = _cut(a.sum(1), b.sum(1), lam)
        if not at:
            continue
        val, gain = np.zeros_like(a), 0.0
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = a[rows].sum(0), b[rows].sum(0)
            _, cut = _cut(gs, hs, lam)
            for cols in (slice(0, cut), slice(cut, None)):
                s, t = gs[cols].sum(), hs[cols].sum()
                val[rows, cols] = s / (t + lam)
                gain += s * s / (t + lam)
        if gain > best_gain:
            best_gain, best = gain, val.T if flip else val
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, bins: int = 48,
        pair_bins: int = 12, max_pairs: int = 10, lam: float = 2.0) -> GamModel:
    """Cyclic boosting of depth-2 trees, one feature at a time, then of the strongest pairs.

    One class only, or no rows: a constant model at the smoothed share of label 1.
    """
    d = len(FEATURES)
    x, y = x.reshape(-1, d), y.astype(float)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        none = [np.empty(0) for _ in range(d)]
        return GamModel(base, none, [np.zeros(1)] * d, [], none, [])
    edges = [_edges(x[:, j], bins) for j in range(d)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-z))
            m = len(tables[j])
            step = rate * _tree(np.bincount(binned[j], y - p, m), np.bincount(binned[j], p * (1 - p), m), 2, lam)
            tables[j] += step
            z += step[binned[j]]
    pair_edges = [_edges(x[:, j], pair_bins) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        flat = coarse[a] * shape[1] + coarse[b]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((-_pair_tree(*grids(a, b), lam)[0], a, b) for a in range(d) for b in range(a + 1, d)))
    pairs = [(a, b) for gain, a, b in ranked[:max_pairs] if gain < -1e-9]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            step = rate * _pair_tree(*grids(a, b), lam)[1]
            pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return GamModel(base, edges, tables, pairs, pair_edges, pair_tables)


def held_out(doc_id, folds: int = 5):
    """True for rows kept out of the fit: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> GamModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out.

    Rows without an id or label teach nothing.  The draw orders ids by hash; a repeated id
    counts once, and one with both labels is left out.  The features are computed on executors,
    so the driver gets ``sample_rows`` feature vectors and no text.
    """
    drawn = (
        labels.select(F.col("doc_id").alias("k"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
        .orderBy(F.xxhash64("k"), "k").limit(sample_rows)
        .select("k", "y")
    )
    # the drawn rows are bounded by sample_rows (two numbers each), so they may be broadcast
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("k"))
    one = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    feats, s = scan_texts(texts, "text", lambda: lambda ts: {"x": [features(t) for t in ts]}, one, ["k", "y"])
    rows = feats.select("k", "y", F.col(f"{s}.x").alias("x")).groupBy("k").agg(F.min(F.struct("x", "y")).alias("r"))
    got = rows.orderBy("k").limit(sample_rows).collect()
    return fit(np.array([r.r.x for r in got], float), np.array([r.r.y for r in got], float))


RESULT = T.StructType([T.StructField("score", T.DoubleType(), False)])


def score_texts(docs: DataFrame, model: GamModel, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Add a struct column with ``score`` (0 to 1) for every row; see ``scan_texts``."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)  # tables of FEATURES x bins numbers: some tens of kB

    def make():
        m = sent.value

        def scan(texts):
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            return {"score": m.score(x).tolist()}

        return scan

    return scan_texts(docs, text_col, make, RESULT, keep, "quality_scan")


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= ``cut``)."""
    ready(docs.sparkSession)
    scored, s = score_texts(docs.select("doc_id", "text"), fit_on(docs, labels, sample_rows), keep=["doc_id"])
    score = F.col(f"{s}.score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        F.when(score >= cut, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The documents the model accepts, with their own columns."""
    scored, s = score_texts(docs, fit_on(docs, labels))
    return scored.where(F.col(f"{s}.score") >= cut).drop(s)
