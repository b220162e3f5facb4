"""Metric suite (T7) and augmentation-run report.

``evaluate`` brings a pair's texts together once, scores its candidates where they meet
(``operators/scores.py``) and writes the numbers, one narrow row per candidate, to the shared checkpoint
folder (reliable storage: a lost executor does not send the job back to the pairing shuffle).  Every metric
family then reads that table:

* g  label flip + confidence          one aggregate by candidate index, then over indexes
* b  BLEU family                      gram counts -> corpus BLEU and BLEU@1..4 in one aggregate, sentence
                                      BLEU mean/var/@n and Pearson in one aggregate, Spearman via
                                      distributed mid-ranks
* c  closeness (token edit distance)  one aggregate + Spearman
* d  diversity (self-BLEU)            one aggregate + Spearman

The result is a long ``(metric, value)`` table, the shape the metrics sink stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipframe.functions.text import space_word_count, word_tokens
from flipframe.operators import metrics as M
from flipframe.operators import ngram
from flipframe.operators.candidates import clean_candidates
from flipframe.operators.models import nli_rule_scorer, parity_scorer, score_pairs, score_texts
from flipframe.operators.pairs import encode_with_map, nli_counter_side, nli_original_text, nli_scoring_sides
from flipframe.operators.scores import candidate_rows, candidate_scores
from flipframe.session import scratch_table, shuffle_partitions

_AT = [f"_at_{n}" for n in range(1, 5)]


def _long(df: DataFrame) -> DataFrame:
    cols = df.columns
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value")


def _materialise(df: DataFrame, on: bool) -> DataFrame:
    if not on:
        return df
    return scratch_table(df, "suite")


def _two_level(rows: DataFrame, score: str, prefix: str, extra_means: list[str] = (), corr: bool = True) -> DataFrame:
    """Per candidate: mean, variance, extra means and Pearson vs size; then across candidates."""
    per = rows.groupBy("idx").agg(F.avg(score).alias("_m"), F.var_pop(score).alias("_v"),
                                  *[F.avg(c).alias(f"_e{c}") for c in extra_means],
                                  *[F.var_pop(c).alias(f"_ev{c}") for c in extra_means],
                                  *([F.corr(score, "counter_size").alias("_p")] if corr else []))
    return per.agg(F.avg("_m").alias(f"{prefix}mean"), F.var_pop("_v").alias(f"{prefix}var"),
                   *[F.avg(f"_e{c}").alias(f"{c}_mean") for c in extra_means],
                   *[F.var_pop(f"_ev{c}").alias(f"{c}_var") for c in extra_means],
                   *([F.avg("_p").alias(f"{prefix}pearson")] if corr else []))


def _spearman_means(stacked: DataFrame) -> DataFrame:
    """One distributed mid-rank pass for every metric family: (family, idx, score, counter_size)
    rows in, ``<family>_spearman`` metric rows out (mean over candidate indexes)."""
    per = M.spearman_by(stacked, "score", "counter_size", by=["family", "idx"])
    return (per.groupBy("family").agg(F.avg("spearman").alias("value"))
            .select(F.concat(F.col("family"), F.lit("_spearman")).alias("metric"), "value"))


def _for_spearman(rows: DataFrame, family: str, score: str) -> DataFrame:
    return rows.select(F.lit(family).alias("family"), F.col("idx").cast("int").alias("idx"),
                       F.round(F.col(score).cast("double"), 12).alias("score"), "counter_size")  # scores that differ by rounding alone are ties


def evaluate(pairs: DataFrame, cands: DataFrame, n: int, metrics: str = "gbcd", scorer=parity_scorer,
             id_col: str = "paired_id", calculate_corr: bool = True, materialise: bool = True, score=None,
             carry: tuple[str, ...] = (), line_trees: bool = False, counted: bool = False) -> DataFrame:
    """Metric flags: g = label flip + confidence, b = BLEU family, c = closeness (token edit
    distance, and with ``line_trees`` the distance of line-aligned one-level trees),
    d = diversity (self-BLEU).  Returns (metric, value) rows.

    ``pairs``: id, example (the seed side), counterfactual (the gold text), label_counter.
    ``score(rows)`` replaces the text scorer: it adds ``pred`` (and ``score``, if it has a
    confidence) to rows that hold the ``carry`` columns of ``pairs`` and ``generated``, or, if ``counted``, the
    numbers of each candidate (its ``n_tokens``), so that no text is tokenised again.
    """
    kept, removed = clean_candidates(pairs, cands, id_col, n)
    # the few candidates of a pair meet in its row; the one shuffle of texts, by pair id with an explicit count:
    # the scores are CPU-heavy per row, so they must not collapse into the few tasks AQE would choose
    lists = cands.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "generated"))).alias("cands"))
    rows = kept.select(id_col, "example", "counterfactual", "label_counter", *carry).join(lists, id_col)
    rows = rows.repartition(shuffle_partitions(pairs.sparkSession), id_col)
    return _metrics(_scored(rows, metrics, scorer, id_col, materialise, score, carry, line_trees, counted), _long(removed), metrics, calculate_corr, line_trees)


def evaluate_lists(pairs: DataFrame, n: int, metrics: str = "gbcd", scorer=parity_scorer, id_col: str = "paired_id",
                   calculate_corr: bool = True, score=None, carry: tuple[str, ...] = (), line_trees: bool = False, counted: bool = False) -> DataFrame:
    """:func:`evaluate` over pairs that hold their candidates (``cands``, an array of (idx, generated)): the
    texts are scored where they lie, and incomplete pairs leave by their numbers."""
    scores = _scored(pairs, metrics, scorer, id_col, True, score, carry, line_trees, counted)
    per = scores.groupBy("id").agg(F.count("n_tokens").alias("_ok"), F.count_if(F.col("place") == 0).alias("_pairs"))
    kept = scores.join(per.where(F.col("_ok") == n).select("id"), "id", "left_semi")
    removed = per.agg(F.coalesce(F.sum(F.when(F.col("_ok") != n, F.col("_pairs"))), F.lit(0)).alias("n_removed"))
    return _metrics(kept, _long(removed), metrics, calculate_corr, line_trees)


def _scored(rows: DataFrame, metrics: str, scorer, id_col: str, materialise: bool, score, carry, line_trees: bool, counted: bool) -> DataFrame:
    """The numbers of every candidate, written once: every metric family reads this table."""
    trees = "c" in metrics and line_trees
    keep = ["id", "label_counter", *carry]
    texts = candidate_rows(rows.withColumn("id", F.col(id_col)), keep, trees)
    if "g" in metrics and not counted:
        texts = score(texts) if score else score_texts(texts, "generated", scorer)
    if not counted:
        keep = ["id", "label_counter", *[c for c in ("pred", "score") if "g" in metrics and c in texts.columns]]
    scores = candidate_scores(texts, keep, "c" in metrics, trees)
    if counted:
        scores = (score(scores) if "g" in metrics else scores).drop(*carry)
    return _materialise(scores, materialise)


def _metrics(scores: DataFrame, removed: DataFrame, metrics: str, calculate_corr: bool, trees: bool) -> DataFrame:
    """All metric rows from the candidates' numbers (:func:`candidate_scores`)."""
    trees = "c" in metrics and trees
    parts = [removed]
    per_idx = scores.where("first")  # grams of an index are counted once
    rank_inputs: list[DataFrame] = []
    # every kept row has all n candidates, so the mean over rows of their mean size is the overall mean
    parts.append(_long(scores.agg(F.avg(F.when(F.col("place") == 0, F.col("counter_size"))).alias("avg_len_counter"))))
    parts.append(_long(scores.agg(F.avg("n_tokens").alias("avg_len_generated_counter"))))

    if "g" in metrics:
        hit = (F.col("pred") == F.col("label_counter")).cast("double")
        aggs = [F.avg(hit).alias("_label_flip")] + ([F.avg("score").alias("_confidence")] if "score" in scores.columns else [])
        per = scores.groupBy("idx").agg(*aggs)
        parts.append(_long(per.agg(*[F.avg(x).alias(x[1:]) for x in per.columns if x != "idx"])))
    if "b" in metrics:
        weights = ngram.bleu_weightings("corpus_bleu")
        corpus = ngram.corpus_bleu_by_idx(per_idx, weights_by_name=weights)
        parts.append(_long(corpus.agg(*[F.avg(k).alias(k) for k in weights])))
        sent = per_idx.select("id", "idx", "counter_size", *[ngram.sentence_bleu_col(w).alias(k)
                                                             for k, w in ngram.bleu_weightings("sent_bleu").items()])
        parts.append(_long(_two_level(sent, "sent_bleu", "sent_bleu_", [f"sent_bleu{k}" for k in _AT], calculate_corr)))
        rank_inputs.append(_for_spearman(sent, "sent_bleu", "sent_bleu"))
    if "c" in metrics:
        dist = scores.select("id", "idx", "counter_size", F.when(F.col("n_seed") > 0, F.col("lev").cast("double") / F.col("n_seed")).alias("lev_norm"))
        parts.append(_long(_two_level(dist, "lev_norm", "lev_", corr=calculate_corr)))
        rank_inputs.append(_for_spearman(dist, "lev", "lev_norm"))
        if trees:
            # candidates of one index share the mean over all their lines
            zss = (scores.where(F.col("tree_lines") > 0).groupBy("id", "idx", "counter_size")
                   .agg((F.sum("tree_sum") / F.sum("tree_lines")).alias("tree_distance")))
            parts.append(_long(_two_level(zss, "tree_distance", "zss_", corr=calculate_corr)))
            rank_inputs.append(_for_spearman(zss, "zss", "tree_distance"))
    if "d" in metrics:
        sb = per_idx.select("id", "counter_size", ngram.self_bleu_col().alias("_score")).groupBy("id", "counter_size").agg(F.avg("_score").alias("self_bleu"))
        aggs = [F.avg("self_bleu").alias("self_bleu_mean"), F.var_pop("self_bleu").alias("self_bleu_var")]
        if calculate_corr:
            aggs.append(F.corr("self_bleu", "counter_size").alias("self_bleu_pearson"))
        parts.append(_long(sb.agg(*aggs)))
        rank_inputs.append(_for_spearman(sb.withColumn("idx", F.lit(0)), "self_bleu", "self_bleu"))
    if calculate_corr and rank_inputs:
        stacked = rank_inputs[0]
        for r in rank_inputs[1:]:
            stacked = stacked.unionByName(r)
        parts.append(_spearman_means(stacked))
    if not calculate_corr:
        # correlations switched off: the metrics are still listed, with a null value
        names = [f"{fam}_{c}" for fam, flag in (("sent_bleu", "b"), ("lev", "c"), ("zss", "c" if trees else "-"), ("self_bleu", "d")) if flag in metrics
                 for c in ("pearson", "spearman")]
        parts += [removed.select(F.lit(n).alias("metric"), F.lit(None).cast("double").alias("value")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_nli(rows: DataFrame, cands: DataFrame | None, n: int, label_map: dict[str, int], metrics: str = "gbcd", id_col: str = "rid",
                 scorer=nli_rule_scorer, **more) -> DataFrame:
    """The suite for premise/hypothesis rows (task RP or RH, original and counter sides, counter_label).

    The seed side is the original text that the task revises, the gold text the revised one; a
    candidate takes the revised side's place when the pair is scored, and flips the label if the
    predicted class is that of ``counter_label``.  Without ``cands`` the rows hold their own candidates.
    """
    carry, counts = ("task", "original_prem", "original_hyp"), getattr(scorer, "on_counts", None)
    # a scorer of counts needs the other side's count alone, taken once for all candidates of the pair
    fixed = [F.when(F.col("task") == task, F.lit(None)).otherwise(F.size(word_tokens(c))).alias(c) for task, c in zip(("RP", "RH"), carry[1:])]
    pairs = rows.select(id_col, "task", *(fixed if counts else carry[1:]), nli_original_text().alias("example"), nli_counter_side().alias("counterfactual"),
                        encode_with_map("counter_label", label_map).alias("label_counter"), *(["cands"] if cands is None else []))
    premise, hypothesis = nli_scoring_sides("n_tokens" if counts else "generated")
    more |= {"id_col": id_col, "carry": carry, "counted": counts is not None, "score": lambda hyp: score_pairs(hyp, premise, hypothesis, counts or scorer)}
    return evaluate_lists(pairs, n, metrics, **more) if cands is None else evaluate(pairs, cands, n, metrics, **more)


def augmentation_sums(runs: DataFrame, run_col: str = "run", scorer=parity_scorer, text_col: str = "generated",
                      target_col: str = "label_counter", seed_col: str = "example") -> DataFrame:
    """Per run the sums and counts behind :func:`augmentation_report`; they add up over any cut of
    the rows into batches."""
    label, score = scorer(F.col(text_col))
    present = F.col(text_col).isNotNull()

    def total(value) -> F.Column:
        return F.coalesce(F.sum(F.when(present, value.cast("double"))), F.lit(0.0))

    return runs.groupBy(run_col).agg(
        F.count_if(~present).alias("n_removed"), F.count_if(present).alias("n_present"),
        F.count_if(present & F.col(target_col).isNotNull()).alias("n_target"),
        F.count_if(present & (label == F.col(target_col))).alias("n_flipped"),
        total(score).alias("sum_confidence"),
        total(space_word_count(seed_col)).alias("sum_len_seed"), F.count_if(present & F.col(seed_col).isNotNull()).alias("n_seed"),
        total(space_word_count(text_col)).alias("sum_len_counter"))


def report_from_sums(sums: DataFrame, run_col: str = "run") -> DataFrame:
    """One report row per run from partial sums, however many partial rows a run has."""
    def mean(total: str, n: str) -> F.Column:
        return F.try_divide(F.sum(total).cast("double"), F.sum(n).cast("double"))

    return sums.groupBy(run_col).agg(
        F.sum("n_removed").alias("n_removed"), mean("n_flipped", "n_target").alias("label_flip"),
        mean("sum_confidence", "n_present").alias("confidence"), mean("sum_len_seed", "n_seed").alias("avg_len_seed"),
        mean("sum_len_counter", "n_present").alias("avg_len_counter"))


def augmentation_report(runs: DataFrame, run_col: str = "run", scorer=parity_scorer, text_col: str = "generated",
                        target_col: str = "label_counter", seed_col: str = "example") -> DataFrame:
    """Per run: null rows removed, label flip, mean confidence, mean words of seed and candidate."""
    return report_from_sums(augmentation_sums(runs, run_col, scorer, text_col, target_col, seed_col), run_col)
