"""Candidate tables: null cleaning, first-flip selection, CAT (augmented training) assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: number of nulls in each column (a single pass)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_null_{c}") for c in cols])


def complete_ids(long: DataFrame, id_col: str, n: int, text_col: str = "generated") -> DataFrame:
    """Ids whose N candidates are all present (long form): the rows the wide-form cleaning keeps."""
    return (long.groupBy(id_col)
            .agg(F.count_if(F.col(text_col).isNotNull()).alias("_ok"))
            .filter(F.col("_ok") == n).select(id_col))


def clean_candidates(pairs: DataFrame, long: DataFrame, id_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Keep pairs whose N candidates are all non-null; also return the removed count (one row)."""
    ok = complete_ids(long, id_col, n)
    kept = pairs.join(ok, on=id_col, how="left_semi")
    removed = (pairs.join(ok.withColumn("_ok", F.lit(1)), on=id_col, how="left")
               .agg(F.count_if(F.col("_ok").isNull()).alias("n_removed")))
    return kept, removed


def first_flip(scored: DataFrame, id_col: str, n: int, target_col: str = "target", idx_col: str = "idx",
               text_col: str = "generated", pred_col: str = "pred") -> DataFrame:
    """Per id the lowest-index candidate whose prediction equals the target; if none, candidate 0.

    Output label is the *predicted* label of the chosen text.  The choice is a hash aggregate over
    numbers; the chosen text is joined back on (id, index).  ``scored`` is read twice, so callers
    with a costly scorer write it first (``session.scratch_table``).
    """
    rank = F.when(F.col(pred_col) == F.col(target_col), F.col(idx_col)).otherwise(F.lit(n) + F.col(idx_col))
    chosen = scored.groupBy(id_col).agg(F.min(rank).alias("_rank"))
    chosen = chosen.select(id_col, (F.col("_rank") % n).cast("int").alias("chosen_idx"))
    texts = scored.select(id_col, F.col(idx_col).cast("int").alias("chosen_idx"), F.col(text_col).alias("text"),
                          F.col(pred_col).cast("int").alias("labels"))
    return chosen.join(texts, on=[id_col, "chosen_idx"]).select(id_col, "chosen_idx", "text", "labels")


def first_flip_two_pass(scored_first: DataFrame, score_rest, id_col: str, n: int, target_col: str = "target",
                        idx_col: str = "idx", text_col: str = "generated", pred_col: str = "pred") -> DataFrame:
    """As :func:`first_flip`, but candidates 1.. are scored only for ids whose candidate 0 failed.

    ``scored_first``: candidate-0 rows with predictions; ``score_rest(ids)`` returns scored
    candidate rows (idx >= 1) for the given failing ids -- the expensive model call is skipped
    for every id that already flipped.
    """
    failed = scored_first.filter(F.col(pred_col) != F.col(target_col)).select(id_col)
    rest = score_rest(failed)
    both = scored_first.unionByName(rest.select(*scored_first.columns))
    return first_flip(both, id_col, n, target_col, idx_col, text_col, pred_col)


def cat_assemble(originals: DataFrame, candidates: DataFrame, text_col: str = "text", label_col: str = "labels",
                 cand_text: str = "generated", cand_label: str = "label_counter") -> DataFrame:
    """Originals plus one generated text per seed labelled with the target label.

    Both sides are projected to exactly (text, labels) before the union, so a stray column on
    one side can never turn the other side's rows into nulls that a later ``dropna`` removes.
    """
    a = originals.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("labels"),
                         F.lit("original").alias("origin"))
    b = candidates.select(F.col(cand_text).alias("text"), F.col(cand_label).cast("int").alias("labels"),
                          F.lit("generated").alias("origin"))
    return a.unionByName(b)
