"""Queries for aggregates (A*), text metrics (T*), windows (W*), sampling/splits (K*), CAT
assembly (U2/U3), first-flip (F6), corpus (C*), metrics sink (S12/S13) and models (M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipframe.functions import templates as TP
from flipframe.functions.order import hash_key, uniform01
from flipframe.functions.text import line_tokens, space_word_count, word_tokens
from flipframe.operators import bayes as BY
from flipframe.operators import candidates as C
from flipframe.operators import corpus as CO
from flipframe.operators import distance as D
from flipframe.operators import metrics as M
from flipframe.operators import models as MD
from flipframe.operators import ngram as NG
from flipframe.operators import pairs as PR
from flipframe.operators import sampling as S
from flipframe.plans import suite as SU
from flipframe.plans import tables as TB
from flipframe.plans.catalog_io import (_COMPLETE_SQL, TOK_SQL, W, hash_sql, kfold_sql, nli_prompt_sql, ntok_sql, sentiment_prompt_sql, sq,
                                        strip_html_sql, tokens_sql, trunc_sql, words_sql)
from flipframe.plans.registry import query
from flipframe.session import scratch_path, scratch_table, shuffle_partitions, spread
from flipframe.sources import files as IO

N = TB.N_CANDIDATES


# --- shared pieces -------------------------------------------------------------------------------

def _kept(spark, d, materialise: bool = False):
    """Complete pairs (all N candidates present) and their long candidates.

    The pairing itself is written once (``tables.conversation_pairs``); with ``materialise`` these
    two tables are as well, for queries that read them from several branches.
    """
    pairs, cands = TB.conversation_pairs(spark, d)
    kept, _ = C.clean_candidates(pairs, cands, "paired_id", N)
    kc = cands.join(kept.select("paired_id", "example", "counterfactual", "label_ex", "label_counter"), "paired_id")
    if materialise:
        kept, kc = scratch_table(kept, "kept"), scratch_table(kc, "candidates")
    return kept, kc


def _matches(spark, d):
    return _match_from(*_kept(spark, d, materialise=True))


def _sentences_with_size(spark, d):
    """(id, idx, s = sentence BLEU, counter_size) from one materialised pairing."""
    kept, kc = _kept(spark, d, materialise=True)
    sizes = kept.select(F.col("paired_id").alias("id"), F.size(word_tokens("counterfactual")).cast("long").alias("counter_size"))
    return _match_from(kept, kc).select("id", "idx", NG.sentence_bleu_col().alias("s")).join(sizes, "id")


def _match_from(kept, kc):
    hyp = kc.select(F.col("paired_id").alias("id"), "idx", word_tokens("generated").alias("hyp_tokens"))
    ref = kept.select(F.col("paired_id").alias("id"), word_tokens("counterfactual").alias("ref_tokens"))
    return NG.match_table(hyp, ref)


def parity_sql(c: str) -> tuple[str, str]:
    t = trunc_sql(c)
    return f"CAST(len({tokens_sql(t)}) % 2 AS INTEGER)", f"(0.5 + (length({t}) % 50) / 100.0)"


def first_letter_sql(c: str) -> tuple[str, str]:
    t = trunc_sql(c)
    return (f"CAST(lower(substr({t}, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') AS INTEGER)",
            f"(0.5 + (length({t}) % 30) / 100.0)")


def ngram_sql(src: str, keys: str, tok: str, name: str) -> str:
    """CTE ``name``: (keys..., n, g, c) n-gram counts of token list column ``tok``."""
    return f"""{name}_x AS (SELECT {keys}, n, unnest(generate_series(1, len({tok}) - n + 1)) AS i, {tok} AS t
  FROM {src} CROSS JOIN range(1, 5) r(n)),
{name} AS (SELECT {keys}, n, array_to_string(t[i:i + n - 1], ' ') AS g, count(*) AS c
  FROM {name}_x GROUP BY ALL)"""


def _p(num: str, den: str) -> str:
    return f"(CASE WHEN {num} > 0 THEN {num} / {den} ELSE 0.1 / {den} END)"


def bleu_sql(nums: list[str], dens: list[str], hyp: str, ref: str, weights) -> str:
    terms = " + ".join(f"{w} * ln({_p(n, dd)})" for w, n, dd in zip(weights, nums, dens) if w != 0)
    bp = f"(CASE WHEN {hyp} > {ref} THEN 1.0 WHEN {hyp} = 0 THEN 0.0 ELSE exp(1.0 - {ref} / {hyp}) END)"
    return f"(CASE WHEN {nums[0]} = 0 THEN 0.0 ELSE {bp} * exp({terms}) END)"


def _den(hyp: str, n: int) -> str:
    return f"greatest({hyp} - {n - 1}, 1)"


WEIGHTS = NG.bleu_weightings("")


def sent_bleu_sql(weights) -> str:
    return bleu_sql([f"num{n}" for n in range(1, 5)], [_den("hyp_len", n) for n in range(1, 5)], "hyp_len", "ref_len", weights)


MATCH_SQL = W(TB.PAIRS_SQL(), _COMPLETE_SQL, f"""hyp_tok AS (SELECT paired_id AS id, idx, {tokens_sql('generated')} AS ht FROM kc),
ref_tok AS (SELECT paired_id AS id, {tokens_sql('counterfactual')} AS rt FROM kept)""",
              ngram_sql("hyp_tok", "id, idx", "ht", "hc"), ngram_sql("ref_tok", "id", "rt", "rc"),
              """clipped AS (SELECT h.id, h.idx, """ + ", ".join(
                  f"sum(CASE WHEN h.n = {n} THEN least(h.c, r.c) END) AS s{n}" for n in range(1, 5)) + """
  FROM hc h JOIN rc r ON h.id = r.id AND h.n = r.n AND h.g = r.g GROUP BY h.id, h.idx),
m AS (SELECT h.id, h.idx, CAST(len(h.ht) AS BIGINT) AS hyp_len, CAST(len(r.rt) AS BIGINT) AS ref_len, """ + ", ".join(
                  f"CAST(coalesce(c.s{n}, 0) AS BIGINT) AS num{n}" for n in range(1, 5)) + """
  FROM hyp_tok h JOIN ref_tok r ON h.id = r.id LEFT JOIN clipped c ON h.id = c.id AND h.idx = c.idx)""",
              body="")


def with_match(*ctes: str, body: str) -> str:
    return MATCH_SQL.rstrip() + (",\n" + ",\n".join(ctes) if ctes else "") + "\n" + body


def corpus_sql(weights) -> str:
    return bleu_sql([f"sum(num{n})" for n in range(1, 5)], [f"sum({_den('hyp_len', n)})" for n in range(1, 5)],
                    "sum(hyp_len)", "sum(ref_len)", weights)


# --- T1-T3: BLEU ---------------------------------------------------------------------------------

@query("bleu_corpus", sql=with_match(body=f"SELECT CAST(idx AS BIGINT) AS idx, {corpus_sql(WEIGHTS[''])} AS corpus_bleu FROM m GROUP BY idx"),
       doubles=["corpus_bleu"])
def bleu_corpus(spark, d):
    """Corpus BLEU (1-4 grams, method-1 smoothing) of every candidate index."""
    return NG.corpus_bleu_by_idx(_matches(spark, d), weights_by_name={"corpus_bleu": NG.UNIFORM_WEIGHTS})


_AT = [f"_at_{n}" for n in range(1, 5)]


@query("bleu_at_n", sql=with_match(
    "sb AS (SELECT idx, " + ", ".join(f"{sent_bleu_sql(WEIGHTS[k])} AS s{k}" for k in _AT) + " FROM m)",
    body="SELECT c.idx, " + ", ".join(f"c.corpus_bleu{k}, s.sent_bleu{k}_mean" for k in _AT) + " FROM (SELECT CAST(idx AS BIGINT) AS idx, "
         + ", ".join(f"{corpus_sql(WEIGHTS[k])} AS corpus_bleu{k}" for k in _AT) + " FROM m GROUP BY idx) c JOIN (SELECT CAST(idx AS BIGINT) AS idx, "
         + ", ".join(f"avg(s{k}) AS sent_bleu{k}_mean" for k in _AT) + " FROM sb GROUP BY idx) s ON c.idx = s.idx"),
    doubles=[f"corpus_bleu{k}" for k in _AT] + [f"sent_bleu{k}_mean" for k in _AT])
def bleu_at_n(spark, d):
    """BLEU@1..4 (one-hot weights) for corpus and sentence BLEU from one count table."""
    m = _matches(spark, d)
    corpus = NG.corpus_bleu_by_idx(m, weights_by_name={f"corpus_bleu{k}": WEIGHTS[k] for k in _AT})
    sent = (m.select("idx", *[NG.sentence_bleu_col(WEIGHTS[k]).alias(f"s{k}") for k in _AT])
            .groupBy("idx").agg(*[F.avg(f"s{k}").alias(f"sent_bleu{k}_mean") for k in _AT]))
    return corpus.join(sent, "idx")


@query("bleu_sentence", sql=with_match(body=f"SELECT id AS paired_id, CAST(idx AS BIGINT) AS idx, {sent_bleu_sql(WEIGHTS[''])} AS sent_bleu FROM m"),
       doubles=["sent_bleu"])
def bleu_sentence(spark, d):
    """Sentence BLEU of every (pair, candidate)."""
    m = _matches(spark, d)
    return m.select(F.col("id").alias("paired_id"), "idx", NG.sentence_bleu_col().alias("sent_bleu"))


# --- T4: self-BLEU ---------------------------------------------------------------------------------

_SELF_SQL = W(TB.PAIRS_SQL(), _COMPLETE_SQL, f"hyp_tok AS (SELECT paired_id AS id, idx, {tokens_sql('generated')} AS ht FROM kc)",
              ngram_sql("hyp_tok", "id, idx", "ht", "hc"), """oth AS (
  SELECT h.id, h.idx, h.n, h.g, h.c, coalesce(max(o.c), 0) AS om
  FROM hc h LEFT JOIN hc o ON h.id = o.id AND h.n = o.n AND h.g = o.g AND o.idx <> h.idx
  GROUP BY h.id, h.idx, h.n, h.g, h.c),
cl AS (SELECT id, idx, """ + ", ".join(f"sum(CASE WHEN n = {n} THEN least(c, om) END) AS s{n}" for n in range(1, 5)) + """
  FROM oth GROUP BY id, idx),
lens AS (SELECT id, idx, len(ht) AS l FROM hyp_tok),
closest AS (SELECT a.id, a.idx, a.l AS hyp_len, arg_min(b.l, abs(b.l - a.l) * 1000000000 + b.l) AS ref_len
  FROM lens a JOIN lens b ON a.id = b.id AND a.idx <> b.idx GROUP BY a.id, a.idx, a.l),
sm AS (SELECT x.id, x.idx, x.hyp_len, x.ref_len, """ + ", ".join(f"coalesce(cl.s{n}, 0) AS num{n}" for n in range(1, 5)) + """
  FROM closest x LEFT JOIN cl ON x.id = cl.id AND x.idx = cl.idx)""",
              body=f"SELECT id AS paired_id, avg({sent_bleu_sql(WEIGHTS[''])}) AS self_bleu FROM sm GROUP BY id")


@query("self_bleu", sql=_SELF_SQL, doubles=["self_bleu"])
def self_bleu(spark, d):
    """T4: self-BLEU of the N candidates of each pair (each against the others)."""
    _, kc = _kept(spark, d)
    toks = kc.select(F.col("paired_id").alias("id"), "idx", word_tokens("generated").alias("tokens"))
    return NG.self_bleu_rows(toks).withColumnRenamed("id", "paired_id")


# --- T5: token edit distance --------------------------------------------------------------------

def _lev_sql(a: str, b: str) -> str:
    v = f"list_distinct({a} || {b})"
    enc = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(list_position({v}, t) AS INTEGER))), '')"
    return f"levenshtein({enc(a)}, {enc(b)})"


@query("token_edit_distance", sql=f"""WITH p AS (
  SELECT s.item_id AS seed_id, c.item_id AS cand_id, {tokens_sql('s.text')} AS a, {tokens_sql('c.text')} AS b
  FROM benchmark s JOIN benchmark c ON c.item_id = s.item_id + 1)
SELECT seed_id, cand_id, CAST({_lev_sql('a', 'b')} AS BIGINT) AS distance,
  CASE WHEN len(a) > 0 THEN {_lev_sql('a', 'b')} / len(a) END AS normalised FROM p""", doubles=["normalised"])
def token_edit_distance(spark, d):
    """T5: token-level edit distance of each benchmark passage to the next one, / seed tokens."""
    b = TB.table(spark, d, "benchmark")
    s = b.select(F.col("item_id").alias("seed_id"), word_tokens("text").alias("a"))
    c = b.select(F.col("item_id").alias("cand_id"), word_tokens("text").alias("b"))
    p = s.join(c, c["cand_id"] == s["seed_id"] + 1)
    out = D.with_token_edit_distance(p, "a", "b", "distance")
    return out.select("seed_id", "cand_id", "distance", D.normalised_distance(F.col("distance"), F.col("a")).alias("normalised"))


def token_lev_sql(a: str, b: str, indel: int = 1) -> str:
    """Token-level edit distance of two lists in DuckDB (substitution 1, insert/delete ``indel``):
    one DP row per token of ``a``, built with nested ``list_reduce``."""
    return f"""list_reduce(list_transform(range(1, len({a}) + 1), lambda i: i),
    lambda prow, i: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: j),
        lambda acc, j: list_append(acc, least(prow[j + 1] + {indel}, acc[len(acc)] + {indel},
                                              prow[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END)),
        [i * {indel}]),
    list_transform(range(0, len({b}) + 1), lambda k: k * {indel}))[len({b}) + 1]"""


@query("token_edit_distance_candidates", sql=W(TB.PAIRS_SQL(), _COMPLETE_SQL, f"tk AS (SELECT paired_id, idx, {tokens_sql('example')} AS a, {tokens_sql('generated')} AS b FROM kc)",
                                              f"ds AS (SELECT *, {token_lev_sql('a', 'b')} AS dist FROM tk)",
                                              body="SELECT paired_id, CAST(idx AS BIGINT) AS idx, CAST(dist AS BIGINT) AS distance, CASE WHEN len(a) > 0 THEN dist / len(a) END AS normalised FROM ds"),
       doubles=["normalised"])
def token_edit_distance_candidates(spark, d):
    """T5 over the kept pairs of all conversations: token edit distance of each candidate to its
    example, / example tokens."""
    _, kc = _kept(spark, d)
    # spread by pair before the distances, as in the suite
    kc = kc.select("paired_id", "idx", "example", "generated").repartition(shuffle_partitions(spark), "paired_id", "idx")
    p = kc.select("paired_id", "idx", word_tokens("example").alias("a"), word_tokens("generated").alias("b"))
    out = D.with_token_edit_distance(p, "a", "b", "distance")
    return out.select("paired_id", "idx", "distance", D.normalised_distance(F.col("distance"), F.col("a")).alias("normalised"))


def _pad_tree_sql(x: str) -> str:
    # distance of a flat tree to the "." pad tree: 3 for an empty line, else 2k (+1 without a "." token)
    return f"(CASE WHEN len({x}) = 0 THEN 3 ELSE 2 * len({x}) + CASE WHEN list_contains({x}, '.') THEN 0 ELSE 1 END END)"


_TREE_SQL = W(TB.PAIRS_SQL(), _COMPLETE_SQL, """tl AS (SELECT paired_id, idx, string_split(example, chr(10)) AS rl,
  string_split(generated, chr(10)) AS gl FROM kc)""",
              """pos AS (SELECT paired_id, idx, rl, gl, unnest(range(1, greatest(len(rl), len(gl)) + 1)) AS p FROM tl)""",
              f"""pr AS (SELECT paired_id, idx, CASE WHEN p <= len(rl) THEN {tokens_sql('rl[p]')} END AS ra,
  CASE WHEN p <= len(gl) THEN {tokens_sql('gl[p]')} END AS gb FROM pos)""",
              f"""d AS (SELECT paired_id, idx, CASE WHEN ra IS NULL THEN {_pad_tree_sql('gb')} WHEN gb IS NULL THEN {_pad_tree_sql('ra')}
  ELSE {token_lev_sql('ra', 'gb', indel=2)} END AS dist FROM pr)""",
              body="SELECT paired_id, CAST(idx AS BIGINT) AS idx, avg(dist) AS tree_distance FROM d GROUP BY paired_id, idx")


@query("tree_edit_distance", sql=_TREE_SQL, doubles=["tree_distance"])
def tree_edit_distance(spark, d):
    """Sentence-aligned tree edit distance (a one-level tree per line), averaged per row."""
    _, kc = _kept(spark, d)
    t = kc.select("paired_id", "idx", line_tokens("example").alias("ref_lines"), line_tokens("generated").alias("gen_lines"))
    return D.flat_tree_distance_rows(t)


@query("tree_edit_distance_nested")
def tree_edit_distance_nested(spark, d):
    """T6 on nested trees (document > line > word), one tree per text (no SQL form; tested against the
    recursive definition)."""
    _, kc = _kept(spark, d)
    doc = lambda c: F.array(F.concat(F.lit("(D "), F.array_join(_line_trees(c), " "), F.lit(")")))
    return D.tree_distance_rows(kc.select("paired_id", "idx", doc("example").alias("ref_trees"), doc("generated").alias("gen_trees")))


# --- A: aggregates ---------------------------------------------------------------------------------

@query("value_counts", sql=W(TB.LABELLED_SQL, body="SELECT CAST(labels AS BIGINT) AS labels, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY labels"))
def value_counts(spark, d):
    """A1: label distribution."""
    return M.value_counts(TB.labelled_text(spark, d), "labels")


@query("length_stats", sql=W(TB.LABELLED_SQL, body="SELECT max(review_len) AS max_len, avg(review_len) AS mean_len, "
                                                    "min(review_len) AS min_len, CAST(count(*) AS BIGINT) AS n_rows FROM labelled"),
       doubles=["mean_len"])
def length_stats(spark, d):
    """A2: max / mean / min length and row count."""
    return M.length_stats(TB.labelled_text(spark, d), "review_len")


@query("distinct_labels", sql=W(TB.LABELLED_SQL, body="SELECT CAST(count(DISTINCT labels) AS BIGINT) AS n_distinct FROM labelled"))
def distinct_labels(spark, d):
    """Number of distinct label values."""
    return M.distinct_count(TB.labelled_text(spark, d), "labels")


@query("score_mean_var", sql=with_match(f"sb AS (SELECT idx, {sent_bleu_sql(WEIGHTS[''])} AS s FROM m)",
                                        body="SELECT avg(m_) AS mean, var_pop(v_) AS var, (SELECT avg(s) FROM sb) AS flat_mean, "
                                             "(SELECT var_pop(s) FROM sb) AS flat_var FROM (SELECT idx, avg(s) AS m_, var_pop(s) AS v_ "
                                             "FROM sb GROUP BY idx) t"),
       doubles=["mean", "var", "flat_mean", "flat_var"])
def score_mean_var(spark, d):
    """A4/A5: flat mean/variance and the two-level (per-candidate, then across) mean/variance."""
    sb = _matches(spark, d).select("idx", NG.sentence_bleu_col().alias("s"))
    per = sb.groupBy("idx").agg(F.avg("s").alias("_m"), F.var_pop("s").alias("_v"), F.sum("s").alias("_s"),
                                F.sum(F.col("s") * F.col("s")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    flat_mean = F.sum("_s") / F.sum("_n")
    return per.agg(F.avg("_m").alias("mean"), F.var_pop("_v").alias("var"), flat_mean.alias("flat_mean"),
                   (F.sum("_q") / F.sum("_n") - flat_mean * flat_mean).alias("flat_var"))


def _scored_cands(spark, d, scorer=MD.parity_scorer):
    _, kc = _kept(spark, d)
    return MD.score_texts(kc, "generated", scorer)


_PARITY_G = parity_sql("generated")
_SCORED_SQL = W(TB.PAIRS_SQL(), _COMPLETE_SQL, f"sc AS (SELECT paired_id, idx, generated, label_counter, {_PARITY_G[0]} AS pred, "
                                               f"{_PARITY_G[1]} AS score FROM kc)", body="")


@query("label_flip", sql=_SCORED_SQL + "SELECT avg(a) AS label_flip FROM (SELECT idx, avg(CAST(pred = label_counter AS DOUBLE)) AS a FROM sc GROUP BY idx) t",
       doubles=["label_flip"])
def label_flip(spark, d):
    """Label-flip score against the desired (counter) label."""
    return M.label_flip_rate(_scored_cands(spark, d), "label_counter")


@query("confidence", sql=_SCORED_SQL + "SELECT avg(a) AS confidence FROM (SELECT idx, avg(score) AS a FROM sc GROUP BY idx) t",
       doubles=["confidence"])
def confidence(spark, d):
    """Mean prediction confidence, per candidate then averaged."""
    return M.mean_confidence(_scored_cands(spark, d))


def _prf_binary_sql(src: str, label: str, pred: str) -> str:
    return f"""SELECT
  CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) + (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END) = 0 THEN 0.0
       ELSE 2 * (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) * (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END)
            / ((CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) + (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END)) END AS f1
FROM (SELECT count_if({label} = 1 AND {pred} = 1) AS tp, count_if({label} = 0 AND {pred} = 1) AS fp,
             count_if({label} = 1 AND {pred} = 0) AS fn, count_if({label} = 0 AND {pred} = 0) AS tn, count(*) AS n FROM {src}) t"""


def _micro_sql(src: str, label: str, pred: str, by: str | None = None) -> str:
    grp = f"{by}, " if by else ""
    gb = f" GROUP BY {by}" if by else ""
    acc = "CASE WHEN tp + miss = 0 THEN 0.0 ELSE tp / (tp + miss) END"
    return f"""SELECT {grp}{acc} AS accuracy, {acc} AS precision, {acc} AS recall,
  CASE WHEN {acc} = 0 THEN 0.0 ELSE 2 * ({acc}) * ({acc}) / (({acc}) + ({acc})) END AS f1
FROM (SELECT {grp}count_if({label} = {pred}) AS tp, count_if({label} <> {pred}) AS miss FROM {src}{gb}) t"""


_PAR_T = parity_sql("text")
_FL_T = first_letter_sql("text")
_PRED_SQL = W(TB.LABELLED_SQL, f"pr AS (SELECT doc_id, labels, {_PAR_T[0]} AS pred, {_FL_T[0]} AS pred_b FROM labelled)", body="")


@query("prf_binary", sql=_PRED_SQL + _prf_binary_sql("pr", "labels", "pred"), doubles=["accuracy", "precision", "recall", "f1"])
def prf_binary(spark, d):
    """Accuracy / precision / recall / F1 of a scorer on the labelled text (class 1 positive)."""
    lt = MD.score_texts(TB.labelled_text(spark, d), "text")
    return M.binary_prf(lt, "labels", "pred")


_NLI_PRED = W(TB.NLI_SQL(), """np AS (SELECT rid, CAST(map_extract(MAP {'contradiction': 0, 'entailment': 1, 'neutral': 2}, counter_label)[1] AS INTEGER) AS label,
  CAST((len(""" + tokens_sql("CASE WHEN task = 'RP' THEN counter_prem ELSE original_prem END") + ") + len(" +
              tokens_sql("CASE WHEN task = 'RH' THEN counter_hyp ELSE original_hyp END") + ")) % 3 AS INTEGER) AS pred FROM nli)", body="")


def _nli_pred(spark, d):
    nli = TB.nli_pairs(spark, d)
    p, h, lab = PR.nli_label_switch(True)
    out = MD.score_pairs(nli, p, h)
    return out.withColumn("label", MD.map_labels(lab, {"contradiction": 0, "entailment": 1, "neutral": 2}))


@query("prf_micro", sql=_NLI_PRED + _micro_sql("np", "label", "pred"), doubles=["accuracy", "precision", "recall", "f1"])
def prf_micro(spark, d):
    """Micro precision/recall/F1/accuracy of a pair scorer on the NLI set."""
    return M.micro_prf(_nli_pred(spark, d), "label", "pred")


@query("score_pairs_batch", sql=_NLI_PRED + "SELECT rid, CAST(pred AS BIGINT) AS pred FROM np")
def score_pairs_batch(spark, d):
    """M2: (premise, hypothesis) -> class id for every NLI row (revised sides)."""
    return _nli_pred(spark, d).select("rid", "pred")


@query("score_pairs_batch_udf", sql=_NLI_PRED + "SELECT rid, CAST(pred AS BIGINT) AS pred FROM np")
def score_pairs_batch_udf(spark, d):
    """M2 through the model path: predict_batch_udf on both texts, arg-max of the class scores."""
    p, h, _ = PR.nli_label_switch(True)
    return MD.score_pairs_udf(TB.nli_pairs(spark, d), p, h, MD.make_joint_count_model, batch_size=256).select("rid", "pred")


_LB_SQL = W(TB.LABELLED_SQL, f"""lp AS (SELECT 'parity' AS model, doc_id, labels, {_PAR_T[0]} AS pred FROM labelled
  UNION ALL SELECT 'first_letter' AS model, doc_id, labels, {_FL_T[0]} AS pred FROM labelled)""", body="")


def _long_preds(spark, d):
    lt = TB.labelled_text(spark, d)
    a = MD.score_texts(lt, "text", MD.parity_scorer).select(F.lit("parity").alias("model"), "doc_id", "labels", "pred")
    b = MD.score_texts(lt, "text", MD.first_letter_scorer).select(F.lit("first_letter").alias("model"), "doc_id", "labels", "pred")
    return a.unionByName(b)


@query("leaderboard", sql=_LB_SQL + _micro_sql("lp", "labels", "pred", by="model"), doubles=["accuracy", "precision", "recall", "f1"])
def leaderboard(spark, d):
    """A10: one metric row per model over a long predictions table."""
    return M.leaderboard(_long_preds(spark, d), "model", "labels", "pred")


_CT_SQL = _PRED_SQL + """SELECT CAST(count_if(pred = labels AND pred_b = labels) AS BIGINT) AS cc,
  CAST(count_if(pred = labels AND pred_b <> labels) AS BIGINT) AS ci,
  CAST(count_if(pred <> labels AND pred_b = labels) AS BIGINT) AS ic,
  CAST(count_if(pred <> labels AND pred_b <> labels) AS BIGINT) AS ii FROM pr"""


def _two_preds(spark, d):
    lt = TB.labelled_text(spark, d)
    a, _ = MD.parity_scorer(F.col("text"))
    b, _ = MD.first_letter_scorer(F.col("text"))
    return lt.select("doc_id", "labels", a.alias("pred"), b.alias("pred_b"))


@query("contingency", sql=_CT_SQL)
def contingency(spark, d):
    """2x2 table of two classifiers (both right / only A / only B / both wrong)."""
    return M.contingency(_two_preds(spark, d), "labels", "pred", "pred_b")


@query("crosstab_margins", sql=_PRED_SQL + """SELECT a_ok, b_ok, CAST(count(*) AS BIGINT) AS n, CAST(GROUPING(a_ok, b_ok) AS BIGINT) AS level
FROM (SELECT CASE WHEN pred = labels THEN 'C' ELSE 'I' END AS a_ok, CASE WHEN pred_b = labels THEN 'C' ELSE 'I' END AS b_ok FROM pr) t
GROUP BY CUBE (a_ok, b_ok)""")
def crosstab_margins(spark, d):
    """Cross-tab of the two classifiers' correctness with both margins and the total."""
    t = _two_preds(spark, d).select(F.when(F.col("pred") == F.col("labels"), "C").otherwise("I").alias("a_ok"),
                                    F.when(F.col("pred_b") == F.col("labels"), "C").otherwise("I").alias("b_ok"))
    return M.crosstab_margins(t, "a_ok", "b_ok")


@query("mcnemar_exact", sql=W(TB.LABELLED_SQL, f"pr AS (SELECT doc_id, labels, {_PAR_T[0]} AS pred, {_FL_T[0]} AS pred_b FROM labelled)",
                              """ct AS (SELECT count_if(pred = labels AND pred_b <> labels) AS b, count_if(pred <> labels AND pred_b = labels) AS c FROM pr)""",
                              body="""SELECT CAST(b AS BIGINT) AS ci, CAST(c AS BIGINT) AS ic, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (
  SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) + (b + c) * ln(0.5)))
  FROM range(0, CAST(least(b, c) + 1 AS BIGINT)) r(k))) END AS p_exact,
  CASE WHEN b + c = 0 THEN 0.0 ELSE least(0.0, (ln(2) + mx + ln((SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) + (b + c) * ln(0.5) - mx))
  FROM range(0, CAST(least(b, c) + 1 AS BIGINT)) r(k)))) / ln(10)) END AS log10_p_exact
FROM (SELECT *, lgamma(b + c + 1) - lgamma(least(b, c) + 1) - lgamma(greatest(b, c) + 1) + (b + c) * ln(0.5) AS mx FROM ct) t"""), doubles=["p_exact", "log10_p_exact"])
def mcnemar_exact(spark, d):
    """Exact McNemar test on the two classifiers' disagreements, as expressions in the JVM."""
    t = M.mcnemar(M.contingency(_two_preds(spark, d), "labels", "pred", "pred_b"))
    return t.select("ci", "ic", "p_exact", "log10_p_exact")


@query("mcnemar_chi2", sql=W(TB.LABELLED_SQL, f"pr AS (SELECT doc_id, labels, {_PAR_T[0]} AS pred, {_FL_T[0]} AS pred_b FROM labelled)",
                             """ct AS (SELECT count_if(pred = labels AND pred_b <> labels) AS b, count_if(pred <> labels AND pred_b = labels) AS c FROM pr)""",
                             body="""SELECT CAST(b AS BIGINT) AS ci, CAST(c AS BIGINT) AS ic,
  CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) END AS chi2,
  -- erfc(sqrt(chi2 / 2)) by the positive series of erf
  1 - 2 / sqrt(pi()) * exp(-chi2_half) * sqrt(chi2_half) * (SELECT sum(exp(j * ln(2 * greatest(chi2_half, 1e-300)) - (lgamma(2 * j + 2) - lgamma(j + 1) - j * ln(2))))
    FROM range(0, 400) s(j)) AS p_chi2,
  (CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) END) > 3.841458820694124 AS significant_05,
  (CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) END) > 6.634896601021214 AS significant_01
FROM (SELECT *, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) / 2 END AS chi2_half FROM ct) t"""),
       doubles=["chi2", "p_chi2"])
def mcnemar_chi2(spark, d):
    """Continuity-corrected chi-square McNemar statistic with .05/.01 significance flags."""
    t = M.mcnemar(M.contingency(_two_preds(spark, d), "labels", "pred", "pred_b"))
    return t.select("ci", "ic", "chi2", "p_chi2", "significant_05", "significant_01")


_CORR_BASE = with_match(f"""sb AS (SELECT m.idx, {sent_bleu_sql(WEIGHTS[''])} AS s, {ntok_sql('k.counterfactual')} AS counter_size
  FROM m JOIN kept k ON m.id = k.paired_id)""", body="")


@query("pearson", sql=_CORR_BASE + "SELECT CAST(idx AS BIGINT) AS idx, corr(s, counter_size) AS pearson FROM sb GROUP BY idx",
       doubles=["pearson"])
def pearson(spark, d):
    """Pearson correlation of sentence BLEU with the gold counterfactual size, per candidate."""
    return M.pearson_by(_sentences_with_size(spark, d), "s", "counter_size")


def _midrank_sql(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


@query("spearman", sql=_CORR_BASE + f"""SELECT CAST(idx AS BIGINT) AS idx, corr(rx, ry) AS spearman FROM (
  SELECT idx, {_midrank_sql('s', 'idx')} AS rx, {_midrank_sql('counter_size', 'idx')} AS ry FROM sb) t GROUP BY idx""",
       doubles=["spearman"])
def spearman(spark, d):
    """Spearman correlation (average ranks for ties), per candidate."""
    return M.spearman_by(_sentences_with_size(spark, d), "s", "counter_size")


# --- C4 / A18 / A19: bigram perplexity -------------------------------------------------------------

_BIGRAM_SQL = W(f"""tr AS (SELECT ['<s>'] || {tokens_sql('text')} AS t FROM documents)""",
                """tr_x AS (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM tr)""",
                """bi AS (SELECT t[i] AS w1, t[i + 1] AS w2, count(*) AS c12 FROM tr_x GROUP BY ALL)""",
                """uni AS (SELECT w1, sum(c12) AS c1 FROM bi GROUP BY w1)""",
                """vn AS (SELECT count(DISTINCT w2) + 1 AS v FROM bi)""",
                f"""ho AS (SELECT item_id, ['<s>'] || {tokens_sql('text')} AS t FROM benchmark)""",
                """ho_x AS (SELECT item_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM ho)""",
                """nll AS (SELECT h.item_id, h.i, -ln((coalesce(b.c12, 0) + 1.0) / (coalesce(u.c1, 0) + 1.0 * (SELECT v FROM vn))) AS nll
  FROM ho_x h LEFT JOIN bi b ON b.w1 = h.t[h.i] AND b.w2 = h.t[h.i + 1] LEFT JOIN uni u ON u.w1 = h.t[h.i])""", body="")


def _nll(spark, d):
    train = TB.table(spark, d, "documents").select("text")
    held = TB.table(spark, d, "benchmark").select("item_id", "text")
    return CO.bigram_token_nll(train, held, "item_id")


@query("bigram_perplexity", sql=_BIGRAM_SQL + "SELECT exp(avg(nll)) AS perplexity, CAST(count(*) AS BIGINT) AS n_tokens FROM nll",
       doubles=["perplexity"])
def bigram_perplexity(spark, d):
    """C4: held-out perplexity of an add-one bigram model (documents -> benchmark)."""
    return _nll(spark, d).agg(F.exp(M.weighted_mean("nll", "n")).alias("perplexity"), F.sum("n").alias("n_tokens"))


@query("perplexity", sql=_BIGRAM_SQL + "SELECT exp(avg(bm)) AS perplexity, avg(bm) AS eval_loss FROM (SELECT item_id // 8 AS b, avg(nll) AS bm FROM nll GROUP BY b) t",
       doubles=["perplexity", "eval_loss"])
def perplexity(spark, d):
    """exp(mean of batch-mean token losses), batches of 8 held-out items."""
    n = _nll(spark, d).withColumn("batch", F.floor(F.col("item_id") / 8))
    return M.perplexity(n, "batch", "nll", "n")


@query("running_loss", sql=_BIGRAM_SQL + """SELECT CAST(item_id // 8 AS BIGINT) AS log_point, avg(loss) AS avg_loss, CAST(count(*) AS BIGINT) AS n_steps
FROM (SELECT item_id, avg(nll) AS loss FROM nll GROUP BY item_id) t GROUP BY log_point""", doubles=["avg_loss"])
def running_loss(spark, d):
    """Average loss per logging interval (a step = one held-out item)."""
    steps = _nll(spark, d).groupBy("item_id").agg(M.weighted_mean("nll", "n").alias("loss"))
    return M.running_loss(steps, "item_id", "loss", 8)


# --- W1 / A3: pairing --------------------------------------------------------------------------

_ASSIGN_SQL = W(TB.PAIRED_SQL, f"""asg AS (SELECT row_id, paired_id, text, sentiment,
  CAST(row_number() OVER (PARTITION BY paired_id ORDER BY {hash_sql(1, 'row_id')}, row_id) = 1 AS INTEGER) AS is_counterfactual
  FROM paired_src)""", body="")


@query("pair_assign", sql=_ASSIGN_SQL + "SELECT row_id, paired_id, CAST(is_counterfactual AS BIGINT) AS is_counterfactual FROM asg")
def pair_assign(spark, d):
    """First row of each pair in seeded-shuffle order is the counterfactual."""
    a = PR.assign_counterfactual(TB.paired_source(spark, d), "paired_id", "row_id", 1)
    return a.select("row_id", "paired_id", "is_counterfactual")


@query("pair_pivot", sql=_ASSIGN_SQL + f"""SELECT paired_id, {strip_html_sql('max(CASE WHEN is_counterfactual = 0 THEN text END)')} AS example,
  CAST(max(CASE WHEN is_counterfactual = 0 THEN sentiment END) AS BIGINT) AS label_ex,
  {strip_html_sql('max(CASE WHEN is_counterfactual = 1 THEN text END)')} AS counterfactual,
  CAST(max(CASE WHEN is_counterfactual = 1 THEN sentiment END) AS BIGINT) AS label_counter
FROM asg GROUP BY paired_id HAVING count(*) = 2 AND sum(is_counterfactual) = 1""")
def pair_pivot(spark, d):
    """A3: two rows per pair -> one (example, counterfactual) row, HTML stripped."""
    return PR.pivot_seeded(TB.paired_source(spark, d), "row_id", 1)


# --- K: sampling and splits ---------------------------------------------------------------------

def _rank_sql(seed, id_col: str, src: str, part: str | None = None) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (f"row_number() OVER ({p}ORDER BY {hash_sql(seed, id_col)}, {id_col}) - 1 AS r, "
            f"count(*) OVER ({'PARTITION BY ' + part if part else ''}) AS n")


@query("seeded_shuffle_head", sql=f"SELECT doc_id, row_number() OVER (ORDER BY {hash_sql(5, 'doc_id')}, doc_id) - 1 AS rank FROM documents")
def seeded_shuffle_head(spark, d):
    """K1/K2: reproducible seeded shuffle: every row with its position (order by rank to read it)."""
    return S.seeded_shuffle(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 5)


@query("exact_sample", sql=f"SELECT doc_id FROM (SELECT doc_id, {_rank_sql(11, 'doc_id', 'documents')} FROM documents) t WHERE r < round_even(n * 0.15, 0)")
def exact_sample(spark, d):
    """K3: exact-size sample without replacement (round-half-even of frac * N)."""
    return S.exact_sample(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 11, frac=0.15)


@query("prefix_split", sql=f"SELECT doc_id, CASE WHEN r < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, {_rank_sql(3, 'doc_id', 'documents')} FROM documents) t")
def prefix_split(spark, d):
    """K6: shuffle then cut at int(0.9 * N)."""
    return S.prefix_split(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 3, 0.9)


def _u_sql(seed, c: str) -> str:
    return f"(CAST('0x' || substr({hash_sql(seed, c)}, 1, 8) AS BIGINT) / 4294967296.0)"


@query("bernoulli_split", sql=f"SELECT doc_id, {_u_sql(23, 'doc_id')} < 0.8 AS is_train FROM documents")
def bernoulli_split(spark, d):
    """K5: independent per-row coin (p = 0.8), stable under repartitioning."""
    return S.bernoulli_split(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 23, 0.8)


def _poisson_sql(seed, lam: float) -> str:
    u = _u_sql(seed, "doc_id")
    k = " + ".join(f"CAST({u} >= {c!r} AS INTEGER)" for c in S.poisson_thresholds(lam))
    return f"""SELECT doc_id, CAST(unnest(generate_series(1, k)) AS BIGINT) AS copy
FROM (SELECT doc_id, {k} AS k FROM documents) t WHERE k > 0"""


@query("sample_with_replacement", sql=_poisson_sql(17, 0.5))
def sample_with_replacement(spark, d):
    """K4: sample with replacement (Poisson copies per row from the row's own hash)."""
    return S.sample_with_replacement(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 17, 0.5)


_DRAW_U = "(CAST('0x' || substr(md5(concat_ws(':', '29', CAST(j AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query("draw_with_replacement", sql=f"""WITH n AS (SELECT count(*) AS n FROM documents),
dr AS (SELECT j AS draw, CAST(floor({_DRAW_U} * n) AS BIGINT) AS pos FROM n, LATERAL (SELECT unnest(range(CAST(round_even(n * 0.5, 0) AS BIGINT))) AS j)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, draw FROM dr JOIN r USING (pos)""")
def draw_with_replacement(spark, d):
    """K4: exactly round(frac * N) uniform draws with replacement."""
    return S.draw_with_replacement(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 29, frac=0.5)


@query("train_val_split", sql=f"SELECT doc_id, CASE WHEN r < round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_rank_sql(42, 'doc_id', 'documents')} FROM documents) t")
def train_val_split(spark, d):
    """K7: seeded train/validation split (validation = round(0.2 N) rows)."""
    return S.train_val_split(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 42, 0.2)


@query("split_60_20_20", sql=f"""WITH a AS (SELECT doc_id, {_rank_sql(19, 'doc_id', 'documents')} FROM documents),
s1 AS (SELECT doc_id, n FROM a WHERE r < round_even(n * 0.8, 0)),
s2 AS (SELECT doc_id, n, row_number() OVER (ORDER BY {hash_sql('19/val', 'doc_id')}, doc_id) - 1 AS r2, count(*) OVER () AS m FROM s1)
SELECT doc_id, CASE WHEN r2 < round_even(m * (n * 0.2 / m), 0) THEN 'val' ELSE 'train' END AS split FROM s2
UNION ALL SELECT doc_id, 'test' AS split FROM a WHERE r >= round_even(n * 0.8, 0)""")
def split_60_20_20(spark, d):
    """K8: train/val/test 60/20/20 with the validation fraction rescaled to the remainder."""
    return S.split_train_val_test(TB.table(spark, d, "documents").select("doc_id"), "doc_id", 19, 0.8, 0.2)


@query("balanced_split", sql=W(TB.LABELLED_SQL, body=f"""SELECT doc_id, CAST(labels AS BIGINT) AS labels,
  CASE WHEN r < round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, labels, {_rank_sql(2023, 'doc_id', 'labelled', 'labels')} FROM labelled) t"""))
def balanced_split(spark, d):
    """Class-balanced split, 25 % of each class as test."""
    lt = TB.labelled_text(spark, d).select("doc_id", "labels")
    return S.balanced_split(lt, "doc_id", "labels", 2023, test_frac=0.25)


@query("balanced_nested_split", sql=W(TB.LABELLED_SQL, f"""bs AS (SELECT doc_id, labels FROM (SELECT doc_id, labels,
  {_rank_sql(2023, 'doc_id', 'labelled', 'labels')} FROM labelled) t WHERE r < least(50, n))""", body=f"""SELECT doc_id, CAST(labels AS BIGINT) AS labels,
  CASE WHEN row_number() OVER (PARTITION BY labels ORDER BY {hash_sql('2023/test', 'doc_id')}, doc_id) - 1 < 10 THEN 'test' ELSE 'train' END AS split FROM bs"""))
def balanced_nested_split(spark, d):
    """Balanced sample of 50 per class, then 10 per class of it as test."""
    lt = TB.labelled_text(spark, d).select("doc_id", "labels")
    return S.balanced_nested_split(lt, "doc_id", "labels", 2023, 50, 10)


@query("nested_samples", sql=W(TB.LABELLED_SQL, f"""o AS (SELECT doc_id FROM (SELECT doc_id, {_rank_sql(2023, 'doc_id', 'labelled')} FROM labelled) t WHERE r < least(300, n)),
o2 AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('2023/n', 'doc_id')}, doc_id) - 1 < 200 AS in_n FROM o),
s AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('2023/m', 'doc_id')}, doc_id) - 1 AS sp FROM o2 WHERE in_n)""",
                               body="""SELECT o2.doc_id, o2.in_n, coalesce(s.sp < 100, false) AS in_seed, CASE WHEN s.sp < 100 THEN s.sp END AS seed_pos
FROM o2 LEFT JOIN s ON o2.doc_id = s.doc_id"""))
def nested_samples(spark, d):
    """Nested samples origin(n+m) > n_data(n) > seed(m), n = 200, m = 100, as flags."""
    lt = TB.labelled_text(spark, d).select("doc_id")
    return S.nested_samples(lt, "doc_id", 2023, 200, 100).select("doc_id", "in_n", "in_seed", "seed_pos")


_SEED_SQL = W(TB.LABELLED_SQL, f"""o AS (SELECT doc_id FROM (SELECT doc_id, {_rank_sql(2023, 'doc_id', 'labelled')} FROM labelled) t WHERE r < least(300, n)),
o2 AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('2023/n', 'doc_id')}, doc_id) - 1 < 200 AS in_n FROM o),
s AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('2023/m', 'doc_id')}, doc_id) - 1 AS sp FROM o2 WHERE in_n)""",
              body="""SELECT l.text AS example, CAST(l.labels AS BIGINT) AS label_ex, l.sentiment AS sentiment_ex,
  CASE WHEN l.sentiment = 'negative' THEN 'positive' ELSE 'negative' END AS sentiment_counter,
  CAST(1 - l.labels AS BIGINT) AS label_counter, s.sp AS paired_id, 'None' AS counterfactual
FROM s JOIN labelled l ON s.doc_id = l.doc_id WHERE s.sp < 100""")


@query("seed_table", sql=_SEED_SQL)
def seed_table(spark, d):
    """The seed sample in the seed layout (inverted label/sentiment, 'None' counterfactual)."""
    lt = TB.labelled_text(spark, d)
    nested = S.nested_samples(lt.select("doc_id", "text", "labels", "sentiment"), "doc_id", 2023, 200, 100)
    return S.seed_table(nested)


@query("kfold_val", sql=W(TB.PAIRS_SQL(), kfold_sql("pairs", "paired_id", 2022), body="SELECT kid AS paired_id, fold, split FROM kf"))
def kfold_val(spark, d):
    """Shuffled 5-fold with a 15 % validation sample from each fold's remainder."""
    pairs, _ = TB.conversation_pairs(spark, d)
    return S.kfold(pairs.select("paired_id"), "paired_id", 2022, 5, 0.15).select(
        "paired_id", F.col("fold").cast("long").alias("fold"), "split")


# --- F6 / U2 / U3 ----------------------------------------------------------------------------------

_FLIP_SQL = _SCORED_SQL.rstrip() + f""",
ff AS (SELECT paired_id, arg_min({{'idx': idx, 'text': generated, 'label': pred}}, CASE WHEN pred = label_counter THEN idx ELSE {N} + idx END) AS c
  FROM sc GROUP BY paired_id)
SELECT paired_id, CAST(c.idx AS BIGINT) AS chosen_idx, c.text AS text, CAST(c.label AS BIGINT) AS labels FROM ff"""


@query("first_flip", sql=_FLIP_SQL)
def first_flip(spark, d):
    """lowest-index candidate whose prediction is the target label, else candidate 0."""
    sc = _scored_cands(spark, d).withColumnRenamed("label_counter", "target")
    return C.first_flip(sc, "paired_id", N)


@query("first_flip_two_pass", sql=_FLIP_SQL)
def first_flip_two_pass(spark, d):
    """F6, lazy variant: candidates 1.. are scored only for pairs whose candidate 0 did not flip."""
    _, kc = _kept(spark, d, materialise=True)
    cols = ["paired_id", "idx", "generated", "label_counter"]
    first = MD.score_texts(kc.filter(F.col("idx") == 0).select(*cols), "generated").withColumnRenamed("label_counter", "target")

    def score_rest(failed):
        rest = kc.filter(F.col("idx") >= 1).select(*cols).join(failed, "paired_id", "left_semi")
        return MD.score_texts(rest, "generated").withColumnRenamed("label_counter", "target")

    return C.first_flip_two_pass(first, score_rest, "paired_id", N)


@query("cat_assemble", sql=W(TB.LABELLED_SQL, TB.PAIRS_SQL(), body="""SELECT text, CAST(labels AS BIGINT) AS labels, 'original' AS origin FROM labelled
UNION ALL SELECT c.generated AS text, CAST(p.label_counter AS BIGINT) AS labels, 'generated' AS origin
FROM cands c JOIN pairs p ON c.paired_id = p.paired_id WHERE c.idx = 0"""))
def cat_assemble(spark, d):
    """Originals plus candidate 0 of every seed with the target label (explicit projection)."""
    pairs, cands = TB.conversation_pairs(spark, d)
    gen = cands.filter(F.col("idx") == 0).join(pairs.select("paired_id", "label_counter"), "paired_id")
    return C.cat_assemble(TB.labelled_text(spark, d), gen)


@query("cat_filtered", sql=W(TB.LABELLED_SQL, TB.PAIRS_SQL().replace("WITH ", ""), _COMPLETE_SQL,
                             f"sc AS (SELECT paired_id, idx, generated, label_counter, {_PARITY_G[0]} AS pred FROM kc)",
                             f"""ff AS (SELECT paired_id, arg_min({{'text': generated, 'label': pred}}, CASE WHEN pred = label_counter THEN idx ELSE {N} + idx END) AS c
  FROM sc GROUP BY paired_id)""",
                             body="""SELECT text, CAST(labels AS BIGINT) AS labels, 'original' AS origin FROM labelled
UNION ALL SELECT c.text AS text, CAST(c.label AS BIGINT) AS labels, 'generated' AS origin FROM ff"""))
def cat_filtered(spark, d):
    """Originals plus the first-flip choice of every seed (label = predicted label)."""
    sc = _scored_cands(spark, d).withColumnRenamed("label_counter", "target")
    ff = C.first_flip(sc, "paired_id", N)
    return C.cat_assemble(TB.labelled_text(spark, d), ff, cand_text="text", cand_label="labels")


# --- C1-C3: token ids, blocks, masking ----------------------------------------------------------------

BLOCK = 510  # a model limit of 512 less two special ids
_SPECIAL_N = len(CO.SPECIAL_IDS)

_VOCAB_SQL = f"""dtok AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
dpos AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(0, len(t) - 1)) AS pos FROM dtok),
voc AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) - 1 + {_SPECIAL_N} AS INTEGER) AS id
  FROM (SELECT token, count(*) AS freq FROM dpos GROUP BY token) v),
enc AS (SELECT p.doc_id, p.pos, coalesce(v.id, {CO.SPECIAL_IDS['<|UNK|>']}) AS id FROM dpos p LEFT JOIN voc v ON p.token = v.token)"""


def _encoded(spark, d):
    """Tokenise the corpus once (written to the shared folder), full vocabulary, one id array a line."""
    docs = spread(TB.table(spark, d, "documents").select(F.col("doc_id").alias("line_id"), "text"))
    toks = scratch_table(CO.tokenize_lines(docs), "tokens")
    vocab = scratch_table(CO.build_vocab(toks), "vocab")
    return toks, vocab, CO.encode_arrays(toks, vocab)


@query("token_ids", sql=W(_VOCAB_SQL, body="SELECT doc_id, array_to_string(list(id ORDER BY pos), ' ') AS ids FROM enc GROUP BY doc_id"))
def token_ids(spark, d):
    """Word-level ids over the full vocabulary (by frequency, ties by token)."""
    _, _, arr = _encoded(spark, d)
    return arr.select(F.col("line_id").alias("doc_id"), F.array_join("ids", " ").alias("ids"))


@query("pad_ids", sql=W(_VOCAB_SQL, """ia AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM enc GROUP BY doc_id)""", body="""SELECT doc_id,
  array_to_string(ids[1:16] || list_transform(range(greatest(16 - len(ids), 0)), lambda x: 0), ' ') AS input_ids,
  array_to_string(list_transform(range(least(len(ids), 16)), lambda x: 1) || list_transform(range(greatest(16 - len(ids), 0)), lambda x: 0), ' ') AS attention_mask,
  array_to_string(ids[1:16] || list_transform(range(greatest(16 - len(ids), 0)), lambda x: 0), ' ') AS labels FROM ia"""))
def pad_ids(spark, d):
    """P20: truncate/pad ids to 16 with an attention mask; labels copy the ids (pads included)."""
    _, _, arr = _encoded(spark, d)
    from flipframe.functions.text import pad_ids as pad

    ids, mask, labels = pad(F.col("ids"), 16, 0)
    return arr.select(F.col("line_id").alias("doc_id"), F.array_join(ids, " ").alias("input_ids"),
                      F.array_join(mask, " ").alias("attention_mask"), F.array_join(labels, " ").alias("labels"))


_BLOCKS_SQL = W(_VOCAB_SQL, f"""starts AS (SELECT doc_id, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dtok),
tot AS (SELECT sum(len(t)) AS total FROM dtok),
blk AS (SELECT CAST((s.start + e.pos) // {BLOCK} AS BIGINT) AS block_id, s.start + e.pos AS gpos, e.id FROM enc e JOIN starts s ON e.doc_id = s.doc_id
  WHERE s.start + e.pos < (SELECT (total // {BLOCK}) * {BLOCK} FROM tot)),
blocks AS (SELECT block_id, list(id ORDER BY gpos) AS ids FROM blk GROUP BY block_id)""", body="")


def _blocks(spark, d):
    """Packed blocks and the vocabulary."""
    toks, vocab, arr = _encoded(spark, d)
    return CO.pack_blocks(arr, CO.line_offsets(toks), BLOCK), vocab


@query("lm_blocks", sql=_BLOCKS_SQL + "SELECT block_id, array_to_string(ids, ' ') AS ids FROM blocks")
def lm_blocks(spark, d):
    """Corpus stream cut into 510-id blocks (distributed prefix sum of line lengths)."""
    return _blocks(spark, d)[0].select("block_id", F.array_join("ids", " ").alias("ids"))


def _mlm_sql(seed) -> str:
    def u(salt, pos):
        return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}/{salt}', CAST(block_id AS VARCHAR), CAST({pos} AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0)"

    special = "[" + ", ".join(str(i) for i in CO.SPECIAL_IDS.values()) + "]"
    vmax = "vmax"
    sel = f"(NOT list_contains({special}, x) AND {u('sel', 'i - 1')} < {CO.MLM_PROBABILITY})"
    rnd = f"CAST(floor({u('rnd', 'i - 1')} * ({vmax} + 1)) AS INTEGER)"
    masked = (f"CASE WHEN NOT {sel} THEN x WHEN {u('band', 'i - 1')} < {CO.MASK_SHARE} THEN {CO.SPECIAL_IDS['<|MASK|>']} "
              f"WHEN {u('band', 'i - 1')} < {CO.MASK_SHARE + CO.RANDOM_SHARE} THEN {rnd} ELSE x END")
    label = f"CASE WHEN {sel} THEN x ELSE {CO.IGNORE_INDEX} END"
    return (f"SELECT block_id, array_to_string(list_transform(ids, lambda x, i: {masked}), ' ') AS input_ids, "
            f"array_to_string(list_transform(ids, lambda x, i: {label}), ' ') AS labels FROM (SELECT *, (SELECT max(id) FROM voc) AS vmax FROM blocks) t")


@query("mlm_mask", sql=_BLOCKS_SQL + _mlm_sql(13))
def mlm_mask(spark, d):
    """Masked-LM inputs and labels from per-position hashes (15 %; 80/10/10)."""
    blocks, vocab = _blocks(spark, d)
    blocks = blocks.crossJoin(F.broadcast(vocab.agg(F.max("id").alias("vmax"))))  # one row
    m = CO.mlm_mask(blocks, 13, F.col("vmax"))
    return m.select("block_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


@query("feature_cache", sql=_BLOCKS_SQL + "SELECT block_id, array_to_string(ids, ' ') AS ids FROM blocks")
def feature_cache(spark, d):
    """Packed blocks built once, then served from the cache (the second call must not build)."""
    path = scratch_path(spark, "features")
    params = {"block": BLOCK, "tokenizer": "words"}

    def no_build():
        raise AssertionError("the cache was not hit")

    older = lambda: spark.createDataFrame([], "block_id long, ids array<int>")
    IO.cached_features(spark, path, older, params=params)
    IO.cached_features(spark, path, lambda: _blocks(spark, d)[0], overwrite_cache=True, params=params)
    cached = IO.cached_features(spark, path, no_build, params=params)
    return cached.select("block_id", F.array_join("ids", " ").alias("ids"))


# --- T7 / T8 / S12: suite, report, metrics table --------------------------------------------------

_LABEL_MAP = {"contradiction": 0, "entailment": 1, "neutral": 2}


def _flat_tree_dist_ctes() -> list[str]:
    """``td`` (paired_id, idx, s): mean distance of line-aligned flat trees, by their closed forms."""
    ctes = _TREE_SQL[_TREE_SQL.index("tl AS ("):_TREE_SQL.rindex("SELECT paired_id")].rstrip()
    return [ctes, "td AS (SELECT paired_id, idx, avg(dist) AS s FROM d GROUP BY paired_id, idx)"]


def _suite_sql(closeness: bool = False, nli: list[str] | None = None) -> str:
    parity = _PARITY_G
    parts = [
        "SELECT 'n_removed' AS metric, CAST((SELECT count(*) FROM pairs) - (SELECT count(*) FROM kept) AS DOUBLE) AS value",
        "SELECT 'label_flip', (SELECT avg(a) FROM (SELECT idx, avg(CAST(pred = label_counter AS DOUBLE)) AS a FROM sc GROUP BY idx) t)",
        f"SELECT 'avg_len_counter', (SELECT avg({ntok_sql('counterfactual')}) FROM kept)",
        f"SELECT 'avg_len_generated_counter', (SELECT avg({ntok_sql('generated')}) FROM kc)",
    ]
    if not nli:
        parts.append("SELECT 'confidence', (SELECT avg(a) FROM (SELECT idx, avg(score) AS a FROM sc GROUP BY idx) t)")
    for k in [""] + _AT:
        parts.append(f"SELECT 'corpus_bleu{k}', (SELECT avg(b) FROM (SELECT idx, {corpus_sql(WEIGHTS[k])} AS b FROM m GROUP BY idx) t)")
    parts.append("SELECT 'sent_bleu_mean', (SELECT avg(mm) FROM (SELECT idx, avg(s) AS mm FROM sb GROUP BY idx) t)")
    parts.append("SELECT 'sent_bleu_var', (SELECT var_pop(vv) FROM (SELECT idx, var_pop(s) AS vv FROM sb GROUP BY idx) t)")
    for k in _AT:
        parts.append(f"SELECT 'sent_bleu{k}_mean', (SELECT avg(mm) FROM (SELECT idx, avg(s{k}) AS mm FROM sb GROUP BY idx) t)")
        parts.append(f"SELECT 'sent_bleu{k}_var', (SELECT var_pop(vv) FROM (SELECT idx, var_pop(s{k}) AS vv FROM sb GROUP BY idx) t)")
    parts.append("SELECT 'sent_bleu_pearson', (SELECT avg(p) FROM (SELECT idx, corr(s, counter_size) AS p FROM sb GROUP BY idx) t)")
    parts.append(f"""SELECT 'sent_bleu_spearman', (SELECT avg(p) FROM (SELECT idx, corr(rx, ry) AS p FROM (SELECT idx, {_midrank_sql('round(s, 12)', 'idx')} AS rx,
  {_midrank_sql('counter_size', 'idx')} AS ry FROM sb) q GROUP BY idx) t)""")
    parts.append("SELECT 'self_bleu_mean', (SELECT avg(self_bleu) FROM selfb)")
    parts.append("SELECT 'self_bleu_var', (SELECT var_pop(self_bleu) FROM selfb)")
    parts.append("SELECT 'self_bleu_pearson', (SELECT corr(self_bleu, counter_size) FROM selfb)")
    parts.append(f"""SELECT 'self_bleu_spearman', (SELECT corr(rx, ry) FROM (SELECT {_midrank_sql('round(self_bleu, 12)', '1')} AS rx,
  {_midrank_sql('counter_size', '1')} AS ry FROM selfb) q)""")
    extra = []
    if closeness:
        extra = [f"""lv AS (SELECT paired_id AS id, idx, {tokens_sql('example')} AS a, {tokens_sql('generated')} AS b FROM kc)""",
                 f"""lvs AS (SELECT l.idx, CASE WHEN len(l.a) > 0 THEN {token_lev_sql('l.a', 'l.b')} / len(l.a) END AS s,
  {ntok_sql('k.counterfactual')} AS counter_size FROM lv l JOIN kept k ON l.id = k.paired_id)"""]
        parts += [
            "SELECT 'lev_mean', (SELECT avg(mm) FROM (SELECT idx, avg(s) AS mm FROM lvs GROUP BY idx) t)",
            "SELECT 'lev_var', (SELECT var_pop(vv) FROM (SELECT idx, var_pop(s) AS vv FROM lvs GROUP BY idx) t)",
            "SELECT 'lev_pearson', (SELECT avg(p) FROM (SELECT idx, corr(s, counter_size) AS p FROM lvs GROUP BY idx) t)",
            f"""SELECT 'lev_spearman', (SELECT avg(p) FROM (SELECT idx, corr(rx, ry) AS p FROM (SELECT idx, {_midrank_sql('round(s, 12)', 'idx')} AS rx,
  {_midrank_sql('counter_size', 'idx')} AS ry FROM lvs WHERE s IS NOT NULL) q GROUP BY idx) t)""",
            "SELECT 'zss_mean', (SELECT avg(mm) FROM (SELECT idx, avg(s) AS mm FROM zs GROUP BY idx) t)",
            "SELECT 'zss_var', (SELECT var_pop(vv) FROM (SELECT idx, var_pop(s) AS vv FROM zs GROUP BY idx) t)",
            "SELECT 'zss_pearson', (SELECT avg(p) FROM (SELECT idx, corr(s, counter_size) AS p FROM zs GROUP BY idx) t)",
            f"""SELECT 'zss_spearman', (SELECT avg(p) FROM (SELECT idx, corr(rx, ry) AS p FROM (SELECT idx, {_midrank_sql('round(s, 12)', 'idx')} AS rx,
  {_midrank_sql('counter_size', 'idx')} AS ry FROM zs) q GROUP BY idx) t)"""]
        extra += [*_flat_tree_dist_ctes(), f"""zs AS (SELECT td.idx, td.s, {ntok_sql('k.counterfactual')} AS counter_size
  FROM td JOIN kept k ON td.paired_id = k.paired_id)"""]
    self_ctes = _SELF_SQL.split("WITH ", 1)[1].rsplit("SELECT id AS paired_id", 1)[0].rstrip()
    # the self-BLEU CTEs repeat the pair CTEs; keep only the ones after hyp n-grams
    self_only = self_ctes[self_ctes.index("oth AS ("):]
    body = "\nUNION ALL ".join(parts)
    scored = f"sc AS (SELECT paired_id, idx, generated, label_counter, {parity[0]} AS pred, {parity[1]} AS score FROM kc)"
    if nli:
        prem, hyp = ("CASE WHEN p.task = 'RP' THEN c.generated ELSE p.original_prem END", "CASE WHEN p.task = 'RH' THEN c.generated ELSE p.original_hyp END")
        scored = (f"sc AS (SELECT c.paired_id, c.idx, c.label_counter, (len({tokens_sql(prem)}) + len({tokens_sql(hyp)})) % 3 AS pred "
                  "FROM kc c JOIN pairs p ON p.paired_id = c.paired_id)")
    sql = with_match(
        scored,
        f"""sb AS (SELECT m.id, m.idx, {sent_bleu_sql(WEIGHTS[''])} AS s, """ + ", ".join(f"{sent_bleu_sql(WEIGHTS[k])} AS s{k}" for k in _AT)
        + f""", {ntok_sql('k.counterfactual')} AS counter_size FROM m JOIN kept k ON m.id = k.paired_id)""",
        self_only,
        f"""selfb AS (SELECT sm.id, avg({sent_bleu_sql(WEIGHTS[''])}) AS self_bleu, any_value({ntok_sql('k.counterfactual')}) AS counter_size
  FROM sm JOIN kept k ON sm.id = k.paired_id GROUP BY sm.id)""",
        *extra,
        body=body)
    return sql.replace(TB.PAIRS_SQL(), ",\n".join(nli)) if nli else sql


def _nli_gen_ctes(src: str) -> list[str]:
    """Prompts and length budgets of the NLI rows ``src``; ``nli_gen`` has the toy generator's texts."""
    side = "CASE WHEN task = 'RP' THEN original_prem ELSE original_hyp END"
    return [f"npr AS (SELECT *, {side} AS example, {nli_prompt_sql(TP.NLI_GENERATION_PROMPT)} AS prompt FROM {src})",
            f"nml AS (SELECT rid, example, least({ntok_sql('prompt')} * 2, 1024) AS max_length FROM npr)",
            "nli_gen AS (" + " UNION ALL ".join(
                f"SELECT rid, CAST({i - 1} AS BIGINT) AS idx, array_to_string((string_split({_rot_sql(i)}, ' '))[1:max_length], ' ') AS generated FROM nml"
                for i in range(1, N + 1)) + ")"]


def _rot_sql(i: int) -> str:
    """SQL twin of the toy generator: seed words rotated by i mod len, cut to max_length words."""
    w = "string_split(example, ' ')"
    k = f"({i} % greatest(len({w}), 1))"
    return f"array_to_string(({w})[{k} + 1:] || ({w})[1:{k}], ' ')"


def _nli_pairs_ctes(*rows: str, src: str) -> list[str]:
    """``pairs`` and ``cands`` of the NLI rows ``src``, which the CTEs ``rows`` define."""
    return [*rows, *_nli_gen_ctes(src),
            f"""pairs AS (SELECT rid AS paired_id, example, 0 AS label_ex, CASE WHEN task = 'RH' THEN counter_hyp ELSE counter_prem END AS counterfactual,
  CASE counter_label {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _LABEL_MAP.items())} END AS label_counter, task, original_prem, original_hyp FROM npr)""",
            "cands AS (SELECT rid AS paired_id, idx, generated FROM nli_gen)"]


_NLI_SHORT_CTES = _nli_pairs_ctes(TB.NLI_SHORT_SQL(), src="nli_s")
# a document has a row in both tasks, so the row id alone names two rows
_NLI_ROWS_CTES = _nli_pairs_ctes(TB.NLI_SQL(), "nli_u AS (SELECT * REPLACE (rid * 2 + CAST(task = 'RH' AS BIGINT) AS rid) FROM nli)", src="nli_u")


_SUITE_SQL = _suite_sql()


@query("eval_suite", sql=_SUITE_SQL, doubles=["value"])
def eval_suite(spark, d):
    """Label flip, confidence, BLEU family and self-BLEU (metric flags 'gbd') as (metric, value)."""
    pairs, cands = TB.conversation_pairs(spark, d)
    return SU.evaluate(pairs.drop("cf_turn"), cands, N, metrics="gbd")


@query("eval_suite_full", sql=_suite_sql(closeness=True), doubles=["value"])
def eval_suite_full(spark, d):
    """T7 with every flag ('gbcd'; closeness by tokens and by line-aligned trees): the flagship job."""
    pairs, cands = TB.conversation_pairs(spark, d)
    return SU.evaluate(pairs.drop("cf_turn"), cands, N, metrics="gbcd", line_trees=True)


def _line_trees(col):
    """One flat bracketed tree per line; null for a null text."""
    return F.transform(F.split(F.col(col), "\n", -1), lambda ln: D.flat_tree(word_tokens(ln)))


def _nli_prompts(rows, *keep):
    """M3 for NLI: generation prompts with the side that the task revises and a length budget."""
    p = rows.select("rid", *keep, PR.nli_original_text().alias("example"), TP.wrap_nli(TP.NLI_GENERATION_PROMPT).alias("prompt"))
    return p.withColumn("max_length", TP.length_budget(F.size(word_tokens("prompt"))))


def _nli_generated(rows):
    """N candidates of each row."""
    return MD.explode_generated(MD.generate_candidates(_nli_prompts(rows), MD.toy_generate, N, ["rid"]), ["rid"])


@query("generate_nli", sql=W(TB.NLI_SQL(), *_nli_gen_ctes("nli"), body="SELECT rid, idx, generated FROM nli_gen"))
def generate_nli(spark, d):
    """M3: NLI generation in Arrow batches over the premise and hypothesis tasks."""
    return _nli_generated(TB.nli_pairs(spark, d))


@query("eval_suite_nli", sql=_suite_sql(closeness=True, nli=_NLI_SHORT_CTES), doubles=["value"])
def eval_suite_nli(spark, d):
    """T7 for NLI: label flip of generated candidates against the counter label, BLEU family, token and
    tree distance to the task's own original side, self-BLEU."""
    return _nli_suite(TB.nli_short(spark, d))


def _nli_rows(spark, d):
    """All premise and hypothesis rows; a document has a row in both tasks, so the task goes into the id."""
    rows = TB.nli_pairs(spark, d, shuffle_partitions(spark))
    return rows.withColumn("rid", F.col("rid") * 2 + (F.col("task") == "RH").cast("long"))


@query("eval_suite_nli_rows", sql=_suite_sql(nli=_NLI_ROWS_CTES), doubles=["value"])
def eval_suite_nli_rows(spark, d):
    """T7 for NLI over all premise and hypothesis rows of the documents, as in generate_nli: label flip,
    BLEU family, self-BLEU."""
    return _nli_suite(_nli_rows(spark, d), "gbd")


@query("eval_suite_nli_documents", doubles=["value"])
def eval_suite_nli_documents(spark, d):
    """The same with token and tree distance (tested against brute force)."""
    return _nli_suite(_nli_rows(spark, d))


def _nli_suite(rows, metrics: str = "gbcd"):
    """The candidates stay in the row that they are made from, so no text is shuffled or written for them."""
    keep = ["rid", *[c for c in TB.NLI_COLS if c not in ("rid", "original_label")]]
    made = MD.generate_candidates(_nli_prompts(rows, *keep[1:]), MD.toy_generate, N, keep)
    cands = F.transform("generated", lambda t, i: F.struct(i.alias("idx"), t.alias("generated")))
    return SU.evaluate_nli(made.select(*keep, cands.alias("cands")), None, N, _LABEL_MAP, metrics, line_trees=True)


@query("metrics_table", sql="SELECT 'suite' AS run, metric, value FROM (" + _SUITE_SQL + ") s", doubles=["value"])
def metrics_table(spark, d):
    """Suite results appended to a long metrics table and read back."""
    pairs, cands = TB.conversation_pairs(spark, d)
    res = SU.evaluate(pairs.drop("cf_turn"), cands, N, metrics="gbd")
    wide = res.groupBy().pivot("metric").agg(F.first("value"))
    path = scratch_path(spark, "metrics")
    IO.append_metrics(wide, path, "suite")
    return IO.read_metrics(spark, path).select("run", "metric", "value")


_REPORT_SQL = W(TB.PAIRS_SQL(), f"""rs AS (SELECT 'prompt-' || CAST(c.idx + 1 AS VARCHAR) AS run, c.generated, p.example, p.label_counter,
  {parity_sql('c.generated')[0]} AS pred, {parity_sql('c.generated')[1]} AS score FROM cands c JOIN pairs p ON c.paired_id = p.paired_id)""",
                body=f"""SELECT run, CAST(count_if(generated IS NULL) AS BIGINT) AS n_removed,
  avg(CASE WHEN generated IS NOT NULL THEN CAST(pred = label_counter AS DOUBLE) END) AS label_flip,
  avg(CASE WHEN generated IS NOT NULL THEN score END) AS confidence,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('example')} AS DOUBLE) END) AS avg_len_seed,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('generated')} AS DOUBLE) END) AS avg_len_counter FROM rs GROUP BY run""")


@query("augmentation_report", sql=_REPORT_SQL, doubles=["label_flip", "confidence", "avg_len_seed", "avg_len_counter"])
def augmentation_report(spark, d):
    """Per run (candidate file): label flip, confidence, mean words of seed and candidate."""
    pairs, cands = TB.conversation_pairs(spark, d)
    runs = cands.join(pairs.select("paired_id", "example", "label_counter"), "paired_id").withColumn(
        "run", F.concat(F.lit("prompt-"), (F.col("idx") + 1).cast("string")))
    return SU.augmentation_report(runs)


# --- M: model plug-ins --------------------------------------------------------------------------------

_PAR_D = parity_sql("text")


@query("score_batch", sql=f"SELECT doc_id, CAST({_PAR_D[0]} AS BIGINT) AS pred, {_PAR_D[1]} AS score FROM documents", doubles=["score"])
def score_batch(spark, d):
    """M1: batch text scoring (rule scorer standing in for a classifier)."""
    return MD.score_texts(TB.table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "pred", "score")


@query("score_batch_udf", sql=f"SELECT doc_id, CAST({_PAR_D[0]} AS BIGINT) AS pred, {_PAR_D[1]} AS score FROM documents",
       doubles=["score"])
def score_batch_udf(spark, d):
    """M1 through the model path: predict_batch_udf over Arrow batches (NumPy model, parity rule)."""
    docs = TB.table(spark, d, "documents").select("doc_id", "text")
    return MD.score_texts_udf(docs, "text", MD.make_parity_model, batch_size=256).select("doc_id", "pred", "score")


def _prompts(pairs):
    p = pairs.select("paired_id", "example", TP.wrap_sentiment(TP.SENTIMENT_GENERATION_PROMPTS["1"]).alias("prompt"))
    return p.withColumn("max_length", TP.length_budget(F.size(word_tokens("prompt"))))


_GEN_SQL = W(TB.PAIRS_SQL(), f"""pr AS (SELECT paired_id, example, {sentiment_prompt_sql(TP.SENTIMENT_GENERATION_PROMPTS['1'])} AS prompt FROM pairs),
ml AS (SELECT paired_id, example, least({ntok_sql('prompt')} * 2, 1024) AS max_length FROM pr)""",
             body=" UNION ALL ".join(
                 f"SELECT paired_id, CAST({i - 1} AS BIGINT) AS idx, array_to_string((string_split({_rot_sql(i)}, ' '))[1:max_length], ' ') AS generated FROM ml"
                 for i in range(1, N + 1)))


@query("generate_batch", sql=_GEN_SQL)
def generate_batch(spark, d):
    """M3: prompts -> N candidates per row in Arrow batches (toy generator plug-in)."""
    pairs, _ = TB.conversation_pairs(spark, d)
    gen = MD.generate_candidates(_prompts(pairs), MD.toy_generate, N, ["paired_id"])
    return MD.explode_generated(gen, ["paired_id"])


_OOD_SQL = W(TB.LABELLED_SQL, f"""sd AS (SELECT doc_id AS paired_id, text AS example, labels AS label_ex, 1 - labels AS label_counter FROM labelled),
pr AS (SELECT paired_id, example, {sentiment_prompt_sql(TP.SENTIMENT_GENERATION_PROMPTS['1'])} AS prompt FROM sd),
ml AS (SELECT paired_id, example, least({ntok_sql('prompt')} * 2, 1024) AS max_length FROM pr)""",
             body=" UNION ALL ".join(
                 f"SELECT paired_id, CAST({i - 1} AS BIGINT) AS idx, array_to_string((string_split({_rot_sql(i)}, ' '))[1:max_length], ' ') AS generated FROM ml"
                 for i in range(1, N + 1)))


@query("generate_ood", sql=_OOD_SQL)
def generate_ood(spark, d):
    """M8: the same generator over another source (labelled documents as seeds)."""
    seeds = TB.labelled_text(spark, d).select(F.col("doc_id").alias("paired_id"), F.col("text").alias("example"),
                                              F.col("labels").alias("label_ex"), (1 - F.col("labels")).alias("label_counter"))
    gen = MD.generate_candidates(_prompts(seeds), MD.toy_generate, N, ["paired_id"])
    return MD.explode_generated(gen, ["paired_id"])


_SWEEP_SQL = W(TB.PAIRS_SQL(), f"""pr AS (SELECT paired_id, example, counterfactual, {sentiment_prompt_sql(TP.SENTIMENT_GENERATION_PROMPTS['1'])} AS prompt FROM pairs),
ml AS (SELECT paired_id, example, counterfactual, least({ntok_sql('prompt')} * 2, 1024) AS max_length FROM pr),
st AS (SELECT * FROM (VALUES (0, 8), (1, 32)) t(setting_id, n_words)),
gen AS (SELECT m.paired_id, s.setting_id, m.counterfactual,
  array_to_string((string_split({_rot_sql(1)}, ' '))[1:least(m.max_length, s.n_words)], ' ') AS text FROM ml m CROSS JOIN st s),
hyp_tok AS (SELECT paired_id, setting_id, {tokens_sql('text')} AS ht FROM gen),
ref_tok AS (SELECT paired_id, setting_id, {tokens_sql('counterfactual')} AS rt FROM gen)""",
               ngram_sql("hyp_tok", "paired_id, setting_id", "ht", "hc"), ngram_sql("ref_tok", "paired_id, setting_id", "rt", "rc"),
               """clipped AS (SELECT h.paired_id, h.setting_id, """ + ", ".join(
                   f"sum(CASE WHEN h.n = {n} THEN least(h.c, r.c) END) AS s{n}" for n in range(1, 5)) + """
  FROM hc h JOIN rc r ON h.paired_id = r.paired_id AND h.setting_id = r.setting_id AND h.n = r.n AND h.g = r.g
  GROUP BY h.paired_id, h.setting_id),
m AS (SELECT h.setting_id, CAST(len(h.ht) AS BIGINT) AS hyp_len, CAST(len(r.rt) AS BIGINT) AS ref_len, """ + ", ".join(
                   f"CAST(coalesce(c.s{n}, 0) AS BIGINT) AS num{n}" for n in range(1, 5)) + """
  FROM hyp_tok h JOIN ref_tok r ON h.paired_id = r.paired_id AND h.setting_id = r.setting_id
  LEFT JOIN clipped c ON h.paired_id = c.paired_id AND h.setting_id = c.setting_id)""",
               f"""sw AS (SELECT setting_id, {sent_bleu_sql(WEIGHTS[''])} AS sb FROM m)""",
               f"""gl AS (SELECT g.setting_id, g.text, p.label_counter, {parity_sql('g.text')[0]} AS pred, {parity_sql('g.text')[1]} AS score
  FROM gen g JOIN pairs p ON p.paired_id = g.paired_id)""",
               body=f"""SELECT CAST(c.setting_id AS BIGINT) AS setting_id, corpus_bleu, sent_bleu_mean, sent_bleu_var, label_flip, confidence, n_null
FROM (SELECT setting_id, {corpus_sql(WEIGHTS[''])} AS corpus_bleu FROM m GROUP BY setting_id) c
JOIN (SELECT setting_id, avg(sb) AS sent_bleu_mean, var_pop(sb) AS sent_bleu_var FROM sw GROUP BY setting_id) s USING (setting_id)
JOIN (SELECT setting_id, avg(CAST(pred = label_counter AS DOUBLE)) AS label_flip, avg(score) AS confidence,
  CAST(count_if(text IS NULL) AS BIGINT) AS n_null FROM gl GROUP BY setting_id) g USING (setting_id)""")


@query("generation_sweep", sql=_SWEEP_SQL, doubles=["corpus_bleu", "sent_bleu_mean", "sent_bleu_var", "label_flip", "confidence"])
def generation_sweep(spark, d):
    """M6: every generation setting over every prompt in one job; corpus and sentence BLEU, label flip,
    confidence and null texts per setting."""
    pairs, _ = TB.conversation_pairs(spark, d)
    settings = [{"setting_id": 0, "n_words": 8}, {"setting_id": 1, "n_words": 32}]
    p = MD.with_settings(_prompts(pairs), settings)
    p = p.withColumn("max_length", F.least(F.col("max_length"), F.col("setting.n_words"))).withColumn(
        "setting_id", F.col("setting.setting_id")).drop("setting")
    gen = MD.generate_candidates(p, MD.toy_generate, 1, ["paired_id", "setting_id"])
    # the generator runs once; its texts are read by the label and the BLEU branch
    g = scratch_table(gen.select("paired_id", "setting_id", F.col("generated")[0].alias("text")), "sweep-texts")
    hyp = g.select(F.struct("paired_id", "setting_id").alias("id"), F.col("setting_id").alias("idx"), word_tokens("text").alias("hyp_tokens"))
    ref = MD.with_settings(pairs, settings).withColumn("setting_id", F.col("setting.setting_id"))
    ref = ref.select(F.struct("paired_id", "setting_id").alias("id"), word_tokens("counterfactual").alias("ref_tokens"))
    m = scratch_table(NG.match_table(hyp, ref), "sweep-matches")
    corpus = NG.corpus_bleu_by_idx(m, idx_col="idx", weights_by_name={"corpus_bleu": NG.UNIFORM_WEIGHTS}).withColumnRenamed("idx", "setting_id")
    sent = m.groupBy(F.col("idx").alias("setting_id")).agg(F.avg(NG.sentence_bleu_col()).alias("sent_bleu_mean"), F.var_pop(NG.sentence_bleu_col()).alias("sent_bleu_var"))
    scored = MD.score_texts(g.join(pairs.select("paired_id", "label_counter"), "paired_id"), "text")
    flip = scored.groupBy("setting_id").agg(F.avg((F.col("pred") == F.col("label_counter")).cast("double")).alias("label_flip"),
                                            F.avg("score").alias("confidence"), F.count_if(F.col("text").isNull()).alias("n_null"))
    return corpus.join(sent, "setting_id").join(flip, "setting_id")


def _train_val_test(spark, d):
    """Hash splits, the same on any cluster: a quarter is test, a fifth of the rest validation."""
    lt = TB.labelled_text(spark, d).select("doc_id", "text", "labels")
    sp = S.train_val_split(lt, "doc_id", 2023, 0.25)
    rest = S.train_val_split(sp.filter(F.col("split") == "train").drop("split"), "doc_id", "2023/sel", 0.2)
    pick = lambda name: rest.filter(F.col("split") == name).drop("split")
    return pick("train"), pick("val"), sp.filter(F.col("split") == "val").drop("split")


def _hash_split_sql(src: str, seed, frac: float, out: str) -> str:
    return (f"{out} AS (SELECT * EXCLUDE (r, n), r < round_even(n * {frac}, 0) AS held FROM (SELECT *, {_rank_sql(seed, 'doc_id', src)} "
            f"FROM {src}) t)")


def _bayes_sql(train: str, texts: str, settings: list[dict], tag: str) -> list[str]:
    """CTEs of the naive Bayes model ``{tag}``: predictions (doc_id, setting, pred) in ``{tag}_p``."""
    st = ", ".join(f"({s['setting']}, CAST({s['alpha']!r} AS DOUBLE), {s['prior']})" for s in settings)
    return [
        f"{tag}_w AS (SELECT token, label, count(*) AS c FROM (SELECT labels AS label, unnest({tokens_sql('text')}) AS token FROM {train}) t GROUP BY ALL)",
        f"{tag}_c AS (SELECT label, tokens, docs, (SELECT count(*) FROM {train}) AS all_docs, (SELECT count(DISTINCT token) FROM {tag}_w) AS v FROM "
        f"(SELECT label, sum(c) AS tokens FROM {tag}_w GROUP BY label) a JOIN (SELECT labels AS label, count(*) AS docs FROM {train} GROUP BY labels) b USING (label))",
        f"{tag}_s AS (SELECT * FROM (VALUES {st}) t(setting, alpha, prior))",
        f"{tag}_n AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM {texts}) t GROUP BY ALL)",
        f"{tag}_k AS (SELECT doc_id, label, setting, sum(n * ln((c + alpha) / alpha)) AS g FROM {tag}_n JOIN {tag}_w USING (token) CROSS JOIN {tag}_s GROUP BY ALL)",
        f"{tag}_l AS (SELECT d.doc_id, s.setting, c.label, CASE WHEN prior THEN ln(docs / all_docs) ELSE 0.0 END "
        f"+ len({tokens_sql('d.text')}) * ln(alpha / (tokens + alpha * v)) + coalesce(g, 0.0) AS score "
        f"FROM {texts} d CROSS JOIN {tag}_c c CROSS JOIN {tag}_s s LEFT JOIN {tag}_k k ON k.doc_id = d.doc_id AND k.label = c.label AND k.setting = s.setting)",
        f"{tag}_p AS (SELECT doc_id, setting, arg_max(label, score) AS pred FROM {tag}_l GROUP BY doc_id, setting)",
    ]


_GRID = BY.settings_grid([0.01, 0.1, 1.0, 10.0], [True, False])
_RANDOM = BY.random_settings(_GRID, 3, 7)
_SPLIT_SQL = [TB.LABELLED_SQL, _hash_split_sql("labelled", 2023, 0.25, "sp1"), "rest AS (SELECT * EXCLUDE (held) FROM sp1 WHERE NOT held)",
              _hash_split_sql("rest", "2023/sel", 0.2, "sp2"), "tr AS (SELECT * FROM sp2 WHERE NOT held)", "va AS (SELECT * FROM sp2 WHERE held)",
              "te AS (SELECT * FROM sp1 WHERE held)"]


def _sweep_ctes(settings) -> list[str]:
    return [*_SPLIT_SQL, *_bayes_sql("tr", "va", settings, "m"), """acc AS (SELECT setting, avg(CAST(pred = labels AS DOUBLE)) AS accuracy
  FROM m_p JOIN va USING (doc_id) GROUP BY setting)""", "top AS (SELECT setting FROM acc ORDER BY accuracy DESC, setting LIMIT 1)"]


def _sweep_body() -> str:
    return "SELECT CAST(setting AS BIGINT) AS setting, alpha, prior, accuracy, setting = (SELECT setting FROM top) AS best FROM m_s JOIN acc USING (setting)"


_BEST_SQL = W(*_sweep_ctes(_GRID), *_bayes_sql("tr", "te", _GRID, "t"),
              "bp AS (SELECT doc_id, labels, pred, setting FROM t_p JOIN te USING (doc_id) WHERE setting = (SELECT setting FROM top))", body="")


@query("train_classifier", sql=_BEST_SQL + """SELECT CAST(any_value(setting) AS BIGINT) AS setting, avg(CAST(pred = labels AS DOUBLE)) AS accuracy,
  coalesce(sum(CAST(pred = 1 AND labels = 1 AS INT)) / nullif(sum(CAST(pred = 1 AS INT)), 0), 0.0) AS precision,
  coalesce(sum(CAST(pred = 1 AND labels = 1 AS INT)) / nullif(sum(CAST(labels = 1 AS INT)), 0), 0.0) AS recall,
  coalesce(2.0 * sum(CAST(pred = 1 AND labels = 1 AS INT)) / nullif(sum(CAST(pred = 1 AS INT)) + sum(CAST(labels = 1 AS INT)), 0), 0.0) AS f1 FROM bp""",
       doubles=["accuracy", "precision", "recall", "f1"])
def train_classifier(spark, d):
    """M4: text classifiers of several settings, the best by validation accuracy, its test metrics."""
    train, val, test = _train_val_test(spark, d)
    p = BY.best_predictions(train, val, test, _GRID, "doc_id").join(test.select("doc_id", "labels"), "doc_id")
    return M.binary_prf(p, "labels", "pred", by=["setting"])


@query("sweep_classifier", sql=W(*_sweep_ctes(_GRID), body=_sweep_body()), doubles=["accuracy"])
def sweep_classifier(spark, d):
    """M5: grid sweep over smoothing and prior, validation accuracy of each setting, the best marked."""
    train, val, _ = _train_val_test(spark, d)
    return BY.sweep(train, val, _GRID, "doc_id")


@query("sweep_classifier_random", sql=W(*_sweep_ctes(_RANDOM), body=_sweep_body()), doubles=["accuracy"])
def sweep_classifier_random(spark, d):
    """M5: random search, three settings of the grid drawn by seed."""
    train, val, _ = _train_val_test(spark, d)
    return BY.sweep(train, val, _RANDOM, "doc_id")


@query("train_classifier_mllib")
def train_classifier_mllib(spark, d):
    """M4: MLlib text classifier (tokenise, TF-IDF, logistic regression) and its test metrics."""
    train, _, test = _train_val_test(spark, d)
    return M.binary_prf(MD.predict(MD.train_classifier(train), test), "labels", "pred")


_CAT_TRAIN = """ct_tr AS (SELECT text, labels FROM tr WHERE text IS NOT NULL UNION ALL SELECT c.generated AS text, p.label_counter AS labels
  FROM cands c JOIN pairs p ON c.paired_id = p.paired_id WHERE c.idx = 0 AND c.generated IS NOT NULL)"""
_ONE = BY.settings_grid([1.0])


@query("cat_vs_origin", sql=W(*_SPLIT_SQL, TB.PAIRS_SQL(), _CAT_TRAIN, *_bayes_sql("tr", "te", _ONE, "a"), *_bayes_sql("ct_tr", "te", _ONE, "b"),
                              "bo AS (SELECT doc_id, labels, a_p.pred AS pa, b_p.pred AS pb FROM te JOIN a_p USING (doc_id) JOIN b_p USING (doc_id))",
                              body="""SELECT cc, ci, ic, ii, CASE WHEN ci + ic > 0 THEN pow(abs(ci - ic) - 1, 2) / (ci + ic) END AS chi2 FROM (SELECT
  CAST(count_if(pa = labels AND pb = labels) AS BIGINT) AS cc, CAST(count_if(pa = labels AND pb <> labels) AS BIGINT) AS ci,
  CAST(count_if(pa <> labels AND pb = labels) AS BIGINT) AS ic, CAST(count_if(pa <> labels AND pb <> labels) AS BIGINT) AS ii FROM bo) t"""),
       doubles=["chi2"])
def cat_vs_origin(spark, d):
    """M7: classifier on originals vs on originals + counterfactuals, same test set, McNemar."""
    train, _, test = _train_val_test(spark, d)
    pairs, cands = TB.conversation_pairs(spark, d)
    gen = cands.filter(F.col("idx") == 0).join(pairs.select("paired_id", "label_counter"), "paired_id")
    cat = C.cat_assemble(train, gen).na.drop(subset=["text", "labels"])
    a = BY.predict(BY.train_counts(train), test, _ONE, "doc_id").select("doc_id", "pred")
    b = BY.predict(BY.train_counts(cat), test, _ONE, "doc_id").select("doc_id", F.col("pred").alias("pred_b"))
    both = test.select("doc_id", "labels").join(a, "doc_id").join(b, "doc_id")
    return M.mcnemar(M.contingency(both, "labels", "pred", "pred_b")).select("cc", "ci", "ic", "ii", "chi2")


_REPORT_COLS = ["label_flip", "confidence", "avg_len_seed", "avg_len_counter"]


@query("metrics_sweep", sql=W(TB.PAIRS_SQL(), f"""rs AS (SELECT 'prompt-' || CAST(c.idx + 1 AS VARCHAR) AS run, c.generated, p.example,
  p.label_counter, {parity_sql('c.generated')[0]} AS pred, {parity_sql('c.generated')[1]} AS score FROM cands c JOIN pairs p ON c.paired_id = p.paired_id),
rp AS (SELECT run, avg(CASE WHEN generated IS NOT NULL THEN CAST(pred = label_counter AS DOUBLE) END) AS label_flip,
  avg(CASE WHEN generated IS NOT NULL THEN score END) AS confidence,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('example')} AS DOUBLE) END) AS avg_len_seed,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('generated')} AS DOUBLE) END) AS avg_len_counter FROM rs GROUP BY run)""",
                              body=f"SELECT 'prompts' AS sweep, run, metric, value FROM (UNPIVOT rp ON {', '.join(_REPORT_COLS)} INTO NAME metric VALUE value) u"),
       doubles=["value"])
def metrics_sweep(spark, d):
    """The reports of all runs of a sweep, committed together and read back."""
    pairs, cands = TB.conversation_pairs(spark, d)
    runs = cands.join(pairs.select("paired_id", "example", "label_counter"), "paired_id").withColumn(
        "run", F.concat(F.lit("prompt-"), (F.col("idx") + 1).cast("string")))
    report = SU.augmentation_report(runs).select("run", *[F.col(c).cast("double").alias(c) for c in _REPORT_COLS])
    path = scratch_path(spark, "sweeps")
    IO.commit_metrics(report.unpivot(["run"], _REPORT_COLS, "metric", "value"), path, "prompts")
    return IO.read_committed_metrics(spark, path).select("sweep", "run", "metric", "value")


# --- streaming: incremental per-file evaluation ---------------------------------------------------

_STREAM_SQL = W(TB.PAIRS_SQL(), f"""rs AS (SELECT 'gpt2@prompt-' || CAST(c.idx + 1 AS VARCHAR) || '@fold-0' AS run, c.generated, p.example,
  p.label_counter, {parity_sql('c.generated')[0]} AS pred, {parity_sql('c.generated')[1]} AS score
  FROM cands c JOIN pairs p ON c.paired_id = p.paired_id)""",
                body=f"""SELECT run, split_part(split_part(run, '@', 2), '-', 2) AS prompt, split_part(split_part(run, '@', 3), '-', 2) AS fold,
  CAST(count_if(generated IS NULL) AS BIGINT) AS n_removed,
  avg(CASE WHEN generated IS NOT NULL THEN CAST(pred = label_counter AS DOUBLE) END) AS label_flip,
  avg(CASE WHEN generated IS NOT NULL THEN score END) AS confidence,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('example')} AS DOUBLE) END) AS avg_len_seed,
  avg(CASE WHEN generated IS NOT NULL THEN CAST({words_sql('generated')} AS DOUBLE) END) AS avg_len_counter FROM rs GROUP BY run""")


@query("streaming_runs_report", sql=_STREAM_SQL, doubles=["label_flip", "confidence", "avg_len_seed", "avg_len_counter"])
def streaming_runs_report(spark, d):
    """S6/T8 incrementally: candidate files land in a folder, a file-source stream reports each."""
    from flipframe.streaming.runs import evaluate_folder, read_report

    pairs, cands = TB.conversation_pairs(spark, d)
    runs = (cands.join(pairs.select("paired_id", "example", "label_counter"), "paired_id")
            .withColumn("run", F.concat(F.lit("gpt2@prompt-"), (F.col("idx") + 1).cast("string"), F.lit("@fold-0")))
            .select("paired_id", "example", "label_counter", "generated", "run"))
    folder, sink, ckpt = (scratch_path(spark, x) for x in ("landing", "report", "stream-ckpt"))
    # several files per run, as parallel generators write them, read over several triggers
    (runs.repartition(24, "paired_id").write.mode("overwrite").partitionBy("run").option("sep", "\t").option("header", "true")
     .option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(folder))
    q = evaluate_folder(spark, folder, sink, ckpt, available_now=True, max_files_per_trigger=40)
    q.awaitTermination()
    return read_report(spark, sink).select("run", "prompt", "fold", "n_removed", "label_flip", "confidence",
                                               "avg_len_seed", "avg_len_counter")


@query("streaming_complete_pairs", sql=W(TB.PAIRS_SQL(), body=f"""SELECT 'gpt2@prompt-1@fold-0' AS run, paired_id, """ + ", ".join(
    f"max(CASE WHEN idx = {i} THEN generated END) AS generated_{i}" for i in range(N)) + f" FROM cands GROUP BY paired_id HAVING count(generated) = {N}"))
def streaming_complete_pairs(spark, d):
    """S6/F4 with keyed state: candidates of a pair spread over files and triggers, one file delivered
    again; each complete pair once."""
    from flipframe.streaming.complete import collect_folder, read_pairs

    _, cands = TB.conversation_pairs(spark, d)
    folder, sink, ckpt = (scratch_path(spark, x) for x in ("candidate-files", "complete-pairs", "complete-ckpt"))
    for part, rows in enumerate([*[cands.where(F.col("idx") == i) for i in reversed(range(N))], cands.where(F.col("idx") == 0)]):
        (rows.select("paired_id", "idx", "generated").coalesce(1).write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
         .option("nullValue", "").option("emptyValue", '""').csv(f"{folder}/part={part}/run=gpt2@prompt-1@fold-0"))
    collect_folder(spark, folder, sink, ckpt, N, max_files_per_trigger=2).awaitTermination()
    return read_pairs(spark, sink).select("run", "paired_id", *[F.get("candidates", i).alias(f"generated_{i}") for i in range(N)])
