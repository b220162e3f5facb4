"""Queries for scans/sinks (S*), projections (P*), filters (F*), joins (J*), set ops (U*).

Every query reads the driver tables (whole tables) and returns a DataFrame; the SQL twin is
the DuckDB oracle over the same parquet views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flipframe.functions import templates as TP
from flipframe.functions.text import (HTML_BLOCK_PATTERN, HTML_TAG_PATTERN, NA_TOKENS, TOKEN_PATTERN,
                                      between_markers, char_count, null_to_none, space_word_count, strip_html,
                                      token_count, truncate_for_scoring)
from flipframe.operators import candidates as C
from flipframe.operators import pairs as PR
from flipframe.operators import sampling as S
from flipframe.plans import tables as TB
from flipframe.plans.registry import query
from flipframe.session import scratch_path, shuffle_partitions, spread
from flipframe.sources import files as IO

N = TB.N_CANDIDATES


def W(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NA_SQL = "(" + ", ".join(sq(t) for t in NA_TOKENS) + ")"
TOK_SQL = sq(TOKEN_PATTERN)


def na_sql(c: str) -> str:
    return f"CASE WHEN {c} IN {NA_SQL} THEN NULL ELSE {c} END"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({c}, {TOK_SQL})"


def ntok_sql(c: str) -> str:
    return f"CAST(len({tokens_sql(c)}) AS BIGINT)"


def words_sql(c: str) -> str:
    return f"CAST(len(string_split({c}, ' ')) AS BIGINT)"


def hash_sql(seed, c: str) -> str:
    return f"md5(concat_ws(':', {sq(str(seed))}, CAST({c} AS VARCHAR)))"


def label_word_sql(c: str) -> str:
    return f"(['Negative', 'Positive'])[{c} + 1]"


ORACLE_ENTITIES = [("copy", "\u00a9"), ("middot", "\u00b7"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("amp", "&")]


def strip_html_sql(c: str) -> str:
    s = f"regexp_replace(regexp_replace({c}, {sq(HTML_BLOCK_PATTERN)}, '', 'g'), {sq(HTML_TAG_PATTERN)}, '', 'g')"
    # the references that the tables hold; "&amp" last, so that "&amp;lt;" stays "&lt;"
    for name, ch in ORACLE_ENTITIES:
        s = f"regexp_replace({s}, '&{name};?', {sq(ch)}, 'g')"
    return s


def trunc_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 512 THEN substr({c}, 1, 511) ELSE {c} END"


# --- S: sources and sinks ----------------------------------------------------------------------

@query("tsv_round_trip", sql=f"SELECT doc_id, {na_sql('text')} AS text, {na_sql('lang')} AS lang, "
                             f"{na_sql('source')} AS source FROM documents")
def tsv_round_trip(spark, d):
    """Documents -> header TSV (quoted newlines/tabs) -> split-wise typed scan with null tokens, landed."""
    docs = TB.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    path = scratch_path(spark, "tsv")
    IO.write_tsv(docs, path)
    rows = IO.read_tsv(spark, path, "doc_id long, text string, lang string, source string")
    return IO.land_parquet(rows, scratch_path(spark, "tsv-landed"))


@query("text_sink_scan", sql="SELECT text FROM benchmark")
def text_sink_scan(spark, d):
    """Headerless one-text-per-line sink and its scan."""
    path = scratch_path(spark, "lines")
    IO.write_lines(TB.table(spark, d, "benchmark"), "text", path)
    return IO.read_lines(spark, path)


@query("csv_column_scan", sql="SELECT text FROM benchmark")
def csv_column_scan(spark, d):
    """S3: comma CSV with header, single-column projection."""
    path = scratch_path(spark, "csv")
    (TB.table(spark, d, "benchmark").write.mode("overwrite").option("header", "true").option("escape", '"')
     .csv(path))
    return IO.read_csv_column(spark, path, "text", "item_id long, text string")


@query("corpus_lines_scan", sql="""SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_id, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) t""")
def corpus_lines_scan(spark, d):
    """Raw text corpus scan: every line of every file with its place in the stream."""
    path = scratch_path(spark, "corpus")
    # part files in document order, so the stream order is known to the oracle; as many ranges as the scan has splits
    docs = TB.table(spark, d, "documents")
    n = max(4, shuffle_partitions(spark), docs.rdd.getNumPartitions())
    docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    docs.select("text").write.mode("overwrite").text(path)
    return IO.read_text_corpus(spark, path).select("line_id", "text")


@query("folder_labelled_scan",
       sql="SELECT 'lang=' || lang AS folder, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label, text "
           "FROM documents")
def folder_labelled_scan(spark, d):
    """One file per document in per-language folders; label = rank of the folder name."""
    path = scratch_path(spark, "folders")
    IO.write_folder_files(spread(TB.table(spark, d, "documents").select("lang", "text")), "lang", "text", path)
    df = IO.read_folder_labelled(spark, path)
    # the sink ends every text with one newline
    text = F.expr("substring(text, 1, length(text) - 1)")
    return df.select("folder", "label", text.alias("text"))


@query("labelled_scan", sql=W(TB.LABELLED_SQL, body="SELECT doc_id, text, CAST(labels AS BIGINT) AS labels, sentiment, "
                                                     "review_len FROM labelled"))
def labelled_scan(spark, d):
    """Labelled-dataset scan (documents joined to labels)."""
    return TB.labelled_text(spark, d)


_RUNS_SQL = W(TB.PAIRS_SQL(), """runs AS (
  SELECT 'gpt2@prompt-' || CAST(idx + 1 AS VARCHAR) || '@fold-0' AS run, generated FROM cands
  UNION ALL SELECT 'baseline' AS run, counterfactual AS generated FROM pairs)""", body="""
SELECT run,
       CASE WHEN len(string_split(run, '@')) > 1 THEN split_part(split_part(run, '@', 2), '-', 2) ELSE 'None' END AS prompt,
       CASE WHEN len(string_split(run, '@')) > 1 THEN split_part(split_part(run, '@', 3), '-', 2) ELSE '0' END AS fold,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(generated IS NULL) AS BIGINT) AS n_null
FROM runs GROUP BY run""")


@query("multi_file_runs", sql=_RUNS_SQL)
def multi_file_runs(spark, d):
    """Candidate files named ``lm@prompt-i@fold-j`` read in one scan, grouped by file."""
    pairs, cands = TB.conversation_pairs(spark, d)
    runs = (cands.select(F.concat(F.lit("gpt2@prompt-"), (F.col("idx") + 1).cast("string"), F.lit("@fold-0")).alias("run"),
                         "paired_id", "generated")
            .unionByName(pairs.select(F.lit("baseline").alias("run"), "paired_id",
                                      F.col("counterfactual").alias("generated"))))
    root = scratch_path(spark, "runs")
    runs.write.mode("overwrite").partitionBy("run").option("sep", "\t").option("header", "true") \
        .option("quote", '"').option("escape", '"').csv(root)
    names = [f"gpt2@prompt-{i + 1}@fold-0" for i in range(N)] + ["baseline"]
    df = IO.read_runs(spark, [f"{root}/run={n}" for n in names], "paired_id long, generated string")
    df = df.withColumn("run", F.regexp_extract("file_path", r"/run=([^/]+)/[^/]+$", 1))
    df = df.withColumn("run", F.expr("url_decode(run)"))
    prompt, fold = IO.parse_run_name(F.col("run"))
    return (df.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("generated").isNull()).alias("n_null"))
            .select("run", prompt.alias("prompt"), fold.alias("fold"), "n_rows", "n_null"))


_RUNNAME_EXPR = "CASE WHEN role = 'system' THEN role ELSE role || '@prompt-' || CAST(turn AS VARCHAR) || '@fold-' || CAST(conv_id AS VARCHAR) END"


@query("run_name_parse", sql=f"""SELECT conv_id, turn,
  CASE WHEN len(string_split(n, '@')) > 1 THEN split_part(split_part(n, '@', 2), '-', 2) ELSE 'None' END AS prompt,
  CASE WHEN len(string_split(n, '@')) > 1 THEN split_part(split_part(n, '@', 3), '-', 2) ELSE '0' END AS fold
FROM (SELECT conv_id, turn, {_RUNNAME_EXPR} AS n FROM conversations) t""")
def run_name_parse(spark, d):
    """Run-name parse with defaults for names without tags."""
    c = TB.table(spark, d, "conversations")
    name = F.when(F.col("role") == "system", F.col("role")).otherwise(
        F.concat(F.col("role"), F.lit("@prompt-"), F.col("turn").cast("string"), F.lit("@fold-"), F.col("conv_id").cast("string")))
    prompt, fold = IO.parse_run_name(name)
    return c.select("conv_id", "turn", prompt.alias("prompt"), fold.alias("fold"))


def kfold_sql(src: str, id_col: str, seed, k: int = 5, val_frac: float = 0.15) -> str:
    return f"""kf_base AS (
  SELECT {id_col} AS kid, row_number() OVER (ORDER BY {hash_sql(seed, id_col)}, {id_col}) - 1 AS r,
         count(*) OVER () AS n FROM {src}),
kf_home AS (
  SELECT kid, CASE WHEN r < (n % {k}) * (n // {k} + 1) THEN r // (n // {k} + 1)
                   ELSE (n % {k}) + (r - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS home FROM kf_base),
kf_all AS (SELECT kid, home, CAST(f.fold AS BIGINT) AS fold FROM kf_home CROSS JOIN range(0, {k}) f(fold)),
kf_rest AS (
  SELECT kid, fold, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql(f'{seed}/val', 'kid')}, kid) - 1 AS r2,
         count(*) OVER (PARTITION BY fold) AS m FROM kf_all WHERE home <> fold),
kf AS (
  SELECT kid, fold, 'test' AS split FROM kf_all WHERE home = fold
  UNION ALL
  SELECT kid, fold, CASE WHEN r2 < round_even(m * {val_frac}, 0) THEN 'val' ELSE 'training' END AS split FROM kf_rest)"""


@query("fold_store_read", sql=W(TB.PAIRS_SQL(), kfold_sql("pairs", "paired_id", 2022),
                                body="SELECT kid AS paired_id, fold, split FROM kf WHERE fold = 0"))
def fold_store_read(spark, d):
    """K-fold output written partitioned by (fold, split); fold 0 read back with pruning."""
    pairs, _ = TB.conversation_pairs(spark, d)
    kf = S.kfold(pairs.select("paired_id"), "paired_id", 2022, k=5, val_frac=0.15)
    path = scratch_path(spark, "folds")
    IO.write_folds(kf, path)
    return IO.read_fold(spark, path, 0).select("paired_id", F.col("fold").cast("long").alias("fold"), "split")


# --- P: projections ------------------------------------------------------------------------------

@query("label_encode", sql=W(TB.LABELLED_SQL, body=f"""SELECT doc_id, {label_word_sql('labels')} AS word,
  CAST(({label_word_sql('labels')} = 'Positive') AS BIGINT) AS code,
  CAST(map_extract(MAP {{'contradiction': 0, 'entailment': 1, 'neutral': 2}},
       (['entailment', 'neutral', 'contradiction'])[doc_id % 3 + 1])[1] AS BIGINT) AS nli_code
FROM labelled"""))
def label_encode(spark, d):
    """Label word -> int ('Positive' = 1) and NLI label name -> class id via a label map."""
    lt = TB.labelled_text(spark, d)
    word = TP.label_word(F.col("labels"))
    nli_name = F.element_at(F.array(*[F.lit(x) for x in TB.NLI_LABELS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return lt.select("doc_id", word.alias("word"), PR.encode_sentiment(word).alias("code"),
                     PR.encode_with_map(nli_name, {"contradiction": 0, "entailment": 1, "neutral": 2}).alias("nli_code"))


@query("label_invert", sql=W(TB.LABELLED_SQL, body="""SELECT doc_id, CAST(1 - labels AS BIGINT) AS label_counter,
  CASE WHEN sentiment = 'negative' THEN 'positive' ELSE 'negative' END AS sentiment_counter FROM labelled"""))
def label_invert(spark, d):
    """Inverted label and inverted sentiment word."""
    lt = TB.labelled_text(spark, d)
    return lt.select("doc_id", PR.invert_label("labels").alias("label_counter"),
                     F.when(F.col("sentiment") == "negative", "positive").otherwise("negative").alias("sentiment_counter"))


@query("row_numbering", sql="SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def row_numbering(spark, d):
    """0..n-1 in doc_id order from distributed bucket offsets (no global window)."""
    return S.row_numbering(TB.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("html_strip", sql=f"SELECT page_id, {strip_html_sql('html')} AS text FROM pages")
def html_strip(spark, d):
    """Visible text of raw HTML pages."""
    return spread(TB.table(spark, d, "pages").select("page_id", "html")).select("page_id", strip_html("html").alias("text"))


@query("word_len_filter", sql=f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {words_sql('text')} AS n_words
FROM documents WHERE length(text) <= 2000 AND {words_sql('text')} BETWEEN 10 AND 2000""")
def word_len_filter(spark, d):
    """Char and space-split word lengths, length-range filter."""
    docs = TB.table(spark, d, "documents")
    out = docs.select("doc_id", char_count("text").alias("n_chars"), space_word_count("text").alias("n_words"))
    return out.filter((F.col("n_chars") <= 2000) & F.col("n_words").between(10, 2000))


@query("token_count", sql=f"SELECT doc_id, {ntok_sql('text')} AS n_tokens FROM documents")
def token_count_q(spark, d):
    """Word tokens per document."""
    return TB.table(spark, d, "documents").select("doc_id", token_count("text").alias("n_tokens"))


_COMPLETE_SQL = f"""complete AS (SELECT paired_id FROM cands GROUP BY paired_id HAVING count_if(generated IS NOT NULL) = {N}),
kept AS (SELECT p.* FROM pairs p WHERE p.paired_id IN (SELECT paired_id FROM complete)),
kc AS (SELECT c.paired_id, c.idx, c.generated, k.example, k.counterfactual, k.label_ex, k.label_counter
       FROM cands c JOIN kept k ON c.paired_id = k.paired_id)"""


@query("candidate_sizes", sql=W(TB.PAIRS_SQL(), _COMPLETE_SQL, body=f"""SELECT paired_id,
  avg({ntok_sql('generated')}) AS generated_size, {ntok_sql('any_value(counterfactual)')} AS counter_size
FROM kc GROUP BY paired_id"""), doubles=["generated_size"])
def candidate_sizes(spark, d):
    """P10: mean token size of the N candidates and the gold counterfactual size per pair."""
    pairs, cands = TB.conversation_pairs(spark, d)
    kept, _ = C.clean_candidates(pairs, cands, "paired_id", N)
    kc = cands.join(kept.select("paired_id", "counterfactual"), "paired_id")
    return kc.groupBy("paired_id").agg(F.avg(token_count("generated")).alias("generated_size"),
                                       token_count(F.any_value("counterfactual")).alias("counter_size"))


@query("truncate_score_text", sql=f"""SELECT conv_id, turn, {trunc_sql('text')} AS scored_text,
  CAST(length({trunc_sql('text')}) AS BIGINT) AS n_chars FROM conversations""")
def truncate_score_text(spark, d):
    """Texts over 512 characters are cut to 511 before scoring."""
    c = TB.table(spark, d, "conversations")
    t = truncate_for_scoring("text")
    return c.select("conv_id", "turn", t.alias("scored_text"), char_count(t).alias("n_chars"))


def _replace_chain_sql(template: str, steps: list[tuple[str, str]]) -> str:
    s = sq(template)
    for ph, val in steps:
        s = f"replace({s}, {sq(ph)}, {val})"
    return s


def _special_sql():
    st = TP.SPECIAL_TOKENS
    return [("<sep>", sq(st["sep_token"])), ("<bos_token>", sq(st["bos_token"])), ("<eos_token>", sq(st["eos_token"]))]


def _seed_word_sql(i: int) -> str:
    return f"coalesce(string_split(example, ' ')[{i + 1}], '')"


def sentiment_prompt_sql(template: str, special: bool = True) -> str:
    steps = [("<label_ex>", label_word_sql("label_ex")), ("<example_text>", "example"),
             ("<label_counter>", label_word_sql("label_counter"))]
    if "<counter_text>" in template:
        steps.append(("<counter_text>", "counterfactual"))
    steps += _special_sql() if special else []
    steps += [(f"<{i}>", _seed_word_sql(i)) for i in range(3)]
    return _replace_chain_sql(template, steps)


SEED_WORDS_TEMPLATE = "<bos_token><label_counter> review:<sep><0> <1> <2>"


@query("prompt_wrap", sql=W(TB.PAIRS_SQL(), body=f"SELECT paired_id, {sentiment_prompt_sql(TP.SENTIMENT_TEMPLATES['1'])} AS prompt FROM pairs"))
def prompt_wrap(spark, d):
    """Sentiment prompt template filled per row (ordered literal substitutions)."""
    pairs, _ = TB.conversation_pairs(spark, d)
    return pairs.select("paired_id", TP.wrap_sentiment(TP.SENTIMENT_TEMPLATES["1"]).alias("prompt"))


@query("prompt_wrap_all", sql=W(TB.PAIRS_SQL(), body="SELECT paired_id, " + ", ".join(
    f"{sentiment_prompt_sql(t)} AS prompt_{k}, {sentiment_prompt_sql(g)} AS generation_{k}"
    for (k, t), g in zip(TP.SENTIMENT_TEMPLATES.items(), TP.SENTIMENT_GENERATION_PROMPTS.values())) + " FROM pairs"))
def prompt_wrap_all(spark, d):
    """Every sentiment template and generation prompt."""
    pairs, _ = TB.conversation_pairs(spark, d)
    cols = [c for k in TP.SENTIMENT_TEMPLATES for c in (TP.wrap_sentiment(TP.SENTIMENT_TEMPLATES[k]).alias(f"prompt_{k}"),
                                                        TP.wrap_sentiment(TP.SENTIMENT_GENERATION_PROMPTS[k]).alias(f"generation_{k}"))]
    return pairs.select("paired_id", *cols)


@query("prompt_wrap_plain", sql=W(TB.PAIRS_SQL(), body=f"SELECT paired_id, {sentiment_prompt_sql(TP.SENTIMENT_TEMPLATES['1'], special=False)} AS prompt FROM pairs"))
def prompt_wrap_plain(spark, d):
    """Special tokens given as "None" are left as they stand in the template."""
    pairs, _ = TB.conversation_pairs(spark, d)
    return pairs.select("paired_id", TP.wrap_sentiment(TP.SENTIMENT_TEMPLATES["1"], spec_tokens="None").alias("prompt"))


@query("prompt_seed_words", sql=W(TB.PAIRS_SQL(), body=f"SELECT paired_id, {sentiment_prompt_sql(SEED_WORDS_TEMPLATE)} AS prompt FROM pairs"))
def prompt_seed_words(spark, d):
    """First three seed words into ``<0> <1> <2>`` slots (empty when the seed is shorter)."""
    pairs, _ = TB.conversation_pairs(spark, d)
    return pairs.select("paired_id", TP.wrap_sentiment(SEED_WORDS_TEMPLATE).alias("prompt"))


def nli_prompt_sql(template: str = TP.NLI_TEMPLATE) -> str:
    steps = [("<original_label>", "original_label"), ("<P>", "original_prem"), ("<H>", "original_hyp"),
             ("<counter_label>", "counter_label"), ("<TC>", "task"),
             ("<counter_text>", "CASE WHEN task = 'RP' THEN counter_prem ELSE counter_hyp END")]
    return _replace_chain_sql(template, steps + _special_sql())


@query("prompt_wrap_nli", sql=W(TB.NLI_SQL(), body=f"SELECT rid, task, {nli_prompt_sql()} AS prompt FROM nli"))
def prompt_wrap_nli(spark, d):
    """NLI template; the counter side is picked by the task tag."""
    return TB.nli_pairs(spark, d).select("rid", "task", TP.wrap_nli().alias("prompt"))


@query("prompt_generate_nli", sql=W(TB.NLI_SQL(), body=f"SELECT rid, task, {nli_prompt_sql(TP.NLI_GENERATION_PROMPT)} AS prompt FROM nli"))
def prompt_generate_nli(spark, d):
    """The NLI generation prompt, which ends where the counter text is to be written."""
    return TB.nli_pairs(spark, d).select("rid", "task", TP.wrap_nli(TP.NLI_GENERATION_PROMPT).alias("prompt"))


@query("nli_side_choice", sql=W(TB.NLI_SQL(), body="""SELECT rid, task,
  CASE WHEN task = 'RP' THEN lower(CASE WHEN task = 'RH' THEN counter_hyp ELSE counter_prem END) ELSE original_prem END AS premise,
  CASE WHEN task = 'RH' THEN lower(CASE WHEN task = 'RH' THEN counter_hyp ELSE counter_prem END) ELSE original_hyp END AS hypothesis,
  CASE WHEN task = 'RH' THEN counter_hyp ELSE counter_prem END AS counter_text,
  CASE WHEN task = 'RP' THEN original_prem ELSE original_hyp END AS original_text
FROM nli"""))
def nli_side_choice(spark, d):
    """premise/hypothesis for scoring a generated text, counter text, original text."""
    nli = TB.nli_pairs(spark, d).withColumn("generated", F.lower(PR.nli_counter_side()))
    prem, hyp = PR.nli_scoring_sides("generated")
    return nli.select("rid", "task", prem.alias("premise"), hyp.alias("hypothesis"),
                      PR.nli_counter_side().alias("counter_text"), PR.nli_original_text().alias("original_text"))


@query("nli_label_switch", sql=W(TB.NLI_SQL(), body="""SELECT rid, 'revised' AS side,
  CASE WHEN task = 'RP' THEN counter_prem ELSE original_prem END AS premise,
  CASE WHEN task = 'RH' THEN counter_hyp ELSE original_hyp END AS hypothesis, counter_label AS label FROM nli
UNION ALL SELECT rid, 'original' AS side, original_prem AS premise, original_hyp AS hypothesis, original_label AS label FROM nli"""))
def nli_label_switch(spark, d):
    """Revised sides against counter_label, or original sides against original_label."""
    nli = TB.nli_pairs(spark, d)
    out = []
    for side, revised in (("revised", True), ("original", False)):
        p, h, lab = PR.nli_label_switch(revised)
        out.append(nli.select("rid", F.lit(side).alias("side"), p.alias("premise"), h.alias("hypothesis"), lab.alias("label")))
    return out[0].unionByName(out[1])


@query("prefix_candidates", sql=W(TB.PAIRS_SQL(), body="""SELECT c.paired_id, c.idx,
  concat_ws(' ', string_split(p.example, ' ')[1], string_split(p.example, ' ')[3], c.generated) AS prefixed
FROM cands c JOIN pairs p ON c.paired_id = p.paired_id"""))
def prefix_candidates(spark, d):
    """Chosen seed words (positions parsed from '[0, 2]') prepended to every candidate."""
    pairs, cands = TB.conversation_pairs(spark, d)
    idxs = TP.parse_index_list("[0, 2]")
    j = cands.join(pairs.select("paired_id", "example"), "paired_id")
    return j.select("paired_id", "idx", TP.prefix_with_seed_words(F.col("generated"), F.col("example"), idxs).alias("prefixed"))


@query("length_budget", sql=W(TB.PAIRS_SQL(), body=f"""SELECT paired_id, {ntok_sql('p')} AS prompt_tokens,
  CAST(least({ntok_sql('p')} * 2, 1024) AS BIGINT) AS max_length, CAST(5 AS BIGINT) AS min_length
FROM (SELECT paired_id, {sentiment_prompt_sql(TP.SENTIMENT_GENERATION_PROMPTS['1'])} AS p FROM pairs) t"""))
def length_budget(spark, d):
    """Generation length budget from the wrapped prompt."""
    pairs, _ = TB.conversation_pairs(spark, d)
    p = pairs.select("paired_id", TP.wrap_sentiment(TP.SENTIMENT_GENERATION_PROMPTS["1"]).alias("p"))
    n = token_count("p")
    return p.select("paired_id", n.alias("prompt_tokens"), TP.length_budget(n).alias("max_length"),
                    F.lit(TP.MIN_OUTPUT_LENGTH).cast("long").alias("min_length"))


@query("between_markers", sql="SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def between_markers_q(spark, d):
    """Text between two markers (page titles)."""
    return TB.table(spark, d, "pages").select("page_id", between_markers("html", "<title>", "</title>").alias("title"))


@query("null_to_none", sql=W(TB.PAIRS_SQL(), body="SELECT paired_id, idx, coalesce(generated, 'None') AS generated FROM cands"))
def null_to_none_q(spark, d):
    """Missing candidate text becomes the literal 'None'."""
    _, cands = TB.conversation_pairs(spark, d)
    return cands.select("paired_id", "idx", null_to_none("generated").alias("generated"))


def _wide_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN idx = {i} THEN generated END) AS generated_counter_{i}" for i in range(N))
    return f"""wide AS (SELECT p.paired_id, p.example, p.label_ex, p.counterfactual, p.label_counter, {cols}
  FROM pairs p JOIN cands c ON p.paired_id = c.paired_id
  GROUP BY p.paired_id, p.example, p.label_ex, p.counterfactual, p.label_counter)"""


def _wide(spark, d):
    pairs, cands = TB.conversation_pairs(spark, d)
    w = PR.candidates_wide(cands, ["paired_id"], N)
    return pairs.drop("cf_turn").join(w, "paired_id")


_GEN_COLS = [f"generated_counter_{i}" for i in range(N)]


@query("drop_any_null", sql=W(TB.PAIRS_SQL(), _wide_sql(), body="SELECT paired_id, CAST(label_ex AS BIGINT) AS label_ex, "
                                                                  "CAST(label_counter AS BIGINT) AS label_counter FROM wide WHERE " +
                                                                  " AND ".join(f"{c} IS NOT NULL" for c in _GEN_COLS)))
def drop_any_null(spark, d):
    """rows with a null in any column are dropped."""
    w = C.drop_any_null(_wide(spark, d))
    return w.select("paired_id", "label_ex", "label_counter")


@query("clean_candidates", sql=W(TB.PAIRS_SQL(), _COMPLETE_SQL, body="""SELECT 'kept' AS what, CAST(count(*) AS BIGINT) AS n FROM kept
UNION ALL SELECT 'removed' AS what, CAST((SELECT count(*) FROM pairs) - (SELECT count(*) FROM kept) AS BIGINT) AS n"""))
def clean_candidates_q(spark, d):
    """pairs with any null candidate removed; the removed count is reported."""
    pairs, cands = TB.conversation_pairs(spark, d)
    kept, removed = C.clean_candidates(pairs, cands, "paired_id", N)
    a = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n")
    b = removed.select(F.lit("removed").alias("what"), F.col("n_removed").alias("n"))
    return a.unionByName(b)


@query("null_counts", sql=W(TB.PAIRS_SQL(), _wide_sql(), body="SELECT " + ", ".join(
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS n_null_{c}" for c in _GEN_COLS + ["counterfactual"]) + " FROM wide"))
def null_counts_q(spark, d):
    """null count per column in one pass."""
    return C.null_counts(_wide(spark, d), _GEN_COLS + ["counterfactual"])


@query("slice_rows", sql="SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 510")
def slice_rows(spark, d):
    """rows [510:530] in id order (the slice is the feature)."""
    return TB.table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").offset(510).limit(20)


# --- J: joins -----------------------------------------------------------------------------------------

@query("nli_first_match_rp", sql=W(TB.NLI_SQL(), body="SELECT rid, original_label, counter_label, task, original_prem, "
                                                       "counter_prem, original_hyp, counter_hyp FROM rp"))
def nli_first_match_rp(spark, d):
    """Revised premise -> original premise/label by equal hypothesis, first match wins."""
    orig = TB.nli_original(spark, d)
    return PR.revised_premise_pairs(TB.nli_revised_premises(spark, d), orig).select(*TB.NLI_COLS)


@query("nli_first_match_rh", sql=W(TB.NLI_SQL(), body="SELECT rid, original_label, counter_label, task, original_prem, "
                                                       "counter_prem, original_hyp, counter_hyp FROM rh"))
def nli_first_match_rh(spark, d):
    """Revised hypothesis -> original hypothesis/label by equal premise, first match wins."""
    orig = TB.nli_original(spark, d)
    return PR.revised_hypothesis_pairs(TB.nli_revised_hypotheses(spark, d), orig).select(*TB.NLI_COLS)


@query("split_complement", sql=f"""WITH s AS (SELECT doc_id FROM (SELECT doc_id,
  row_number() OVER (ORDER BY {hash_sql(7, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) t
  WHERE r < round_even(n * 0.2, 0))
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def split_complement(spark, d):
    """Complement of a seeded 20 % sample by anti-join on identity."""
    docs = TB.table(spark, d, "documents").select("doc_id")
    sample = S.exact_sample(docs, "doc_id", 7, frac=0.2)
    return S.complement(docs, sample, "doc_id")


# --- U: set operations / reshaping ------------------------------------------------------------------

@query("union_splits", sql=W(TB.NLI_SQL(), body="SELECT task, CAST(count(*) AS BIGINT) AS n FROM nli GROUP BY task"))
def union_splits(spark, d):
    """RP and RH pair sets unioned by name."""
    return TB.nli_pairs(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("candidates_long", sql=W(TB.PAIRS_SQL(), _wide_sql(), body=" UNION ALL ".join(
    f"SELECT paired_id, CAST({i} AS BIGINT) AS idx, generated_counter_{i} AS generated FROM wide" for i in range(N))))
def candidates_long_q(spark, d):
    """Wide candidate columns -> long (paired_id, idx, generated)."""
    return PR.candidates_long(_wide(spark, d), ["paired_id"], N)


@query("candidates_wide", sql=W(TB.PAIRS_SQL(), _wide_sql(), body="SELECT paired_id, " + ", ".join(_GEN_COLS) + " FROM wide"))
def candidates_wide_q(spark, d):
    """Long -> wide with exactly N columns."""
    _, cands = TB.conversation_pairs(spark, d)
    return PR.candidates_wide(cands, ["paired_id"], N)
