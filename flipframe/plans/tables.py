"""The driver's tables in the roles the operators expect.

| role                       | built from |
| labelled text              | documents JOIN labels (labels = quality) |
| paired source, 2 rows/id   | documents: paired_id = doc_id div 2, sentiment = doc_id % 2 |
| pair table + N candidates  | conversations: each user turn = example, the assistant turn after
|                            | it = counterfactual, the N turns after that = candidates 0..N-1 |
| NLI original / revised     | documents (premise = lang:source, hypothesis = text, label by doc_id),
|                            | revised premise rows from documents + benchmark, revised hypotheses
|                            | from documents |
| LM corpus / held-out       | documents.text by doc_id / benchmark.text |

Each Spark builder has a DuckDB twin (``*_SQL``) used by the correctness oracle; both read the
whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipframe.session import bucketed_table, input_digest, scratch_table

N_CANDIDATES = 3
# fixed value: NLI label names by class id
NLI_LABELS = ["entailment", "neutral", "contradiction"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- labelled text -------------------------------------------------------------------------
def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(labels, on="doc_id", how="inner")
    return j.select("doc_id", "text", F.col("quality").cast("int").alias("labels"),
                    F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"),
                    F.size(F.split("text", " ", -1)).cast("long").alias("review_len"))


LABELLED_SQL = """labelled AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS labels,
         CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
         CAST(len(string_split(d.text, ' ')) AS BIGINT) AS review_len
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# --- paired source ---------------------------------------------------------------------------
def paired_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("row_id"), F.floor(F.col("doc_id") / 2).cast("long").alias("paired_id"),
                    "text", (F.col("doc_id") % 2).cast("int").alias("sentiment"))


PAIRED_SQL = """paired_src AS (
  SELECT doc_id AS row_id, CAST(doc_id // 2 AS BIGINT) AS paired_id, text, CAST(doc_id % 2 AS INTEGER) AS sentiment
  FROM documents)"""


# --- pair table and candidates from conversations ---------------------------------------------
TURNS = 1 << 20  # paired_id = conv_id * TURNS + turn of the user text, while turn < TURNS


def pair_key(conv_id: Column, turn: Column) -> Column:
    """One BIGINT for (conv_id, turn), different for different pairs of any size.

    Turns below ``TURNS`` of conversations 0 .. 2^43 - 1 get conv_id * TURNS + turn.  All others get
    a negative number from Cantor's pairing of the two, so the later turns of a long conversation meet
    no id of the next one; what 64 bits can't number is an error, never a shared id.
    """
    conv_id, turn = conv_id.cast("long"), turn.cast("long")
    small = turn.between(0, TURNS - 1) & conv_id.between(0, (1 << 43) - 1)
    numbered = lambda x: x.between(-(1 << 30), (1 << 30) - 1)
    natural = lambda x: F.when(x < 0, -2 * x - 1).otherwise(2 * x)
    total = natural(conv_id) + natural(turn)
    odd = total % 2
    triangle = F.shiftright(total + odd, 1) * (total + 1 - odd)
    return (F.when(small, conv_id * TURNS + turn)
            .when(numbered(conv_id) & numbered(turn), -1 - triangle - natural(turn))
            .otherwise(F.raise_error(F.concat_ws(" ", F.lit("no pair id for conversation and turn"), conv_id, turn)).cast("long")))


def _with_pair_ids(pairs: DataFrame) -> DataFrame:
    """``pairs`` written with a ``paired_id`` in place of its turn, different for every (conv_id, turn).

    Where both numbers are small it is conv_id * TURNS + turn.  All others, such as hashed
    conversation ids, get -1 - their position among their kind, so there is no pair without an id.
    """
    from flipframe.operators.positions import global_position

    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    small = turn.between(0, TURNS - 1) & conv.between(0, (1 << 43) - 1)
    cols = ["conv_id", "paired_id", "example", "label_ex", "counterfactual", "label_counter", "cf_turn"]
    # the guard keeps the product from overflowing where the pair gets a position instead
    out = scratch_table(pairs.withColumn("paired_id", F.when(small, F.when(small, conv).otherwise(0) * TURNS + turn)), "pairs")
    far = out.where(F.col("paired_id").isNull())
    if far.isEmpty():
        return out.select(*cols)
    keys = global_position(far.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "_at")
    far = far.drop("paired_id").join(keys, ["conv_id", "turn"]).withColumn("paired_id", -1 - F.col("_at"))
    return scratch_table(out.where(F.col("paired_id").isNotNull()).select(*cols).unionByName(far.select(*cols)), "pairs-numbered")


def conversation_pairs(spark: SparkSession, sf_dir: str, n: int = N_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(pairs, candidates_long), tables bucketed and sorted by pair id.

    Every exchange is a pair: a user turn (example) and the assistant turn right after it
    (counterfactual); the ``n`` turns after that are its candidates.

    pairs: paired_id, example, label_ex, counterfactual, label_counter, cf_turn
    candidates_long: paired_id, idx, generated -- one row per idx 0..n-1 (null when missing)

    The tables are named by a digest of the conversation files, so a session makes them once, and
    pairs meet their candidates without an exchange.
    """
    digest = input_digest(spark, f"{sf_dir}/conversations.parquet")
    made: list[DataFrame] = []

    def numbered() -> DataFrame:
        if not made:
            conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
            # every join is keyed by (conversation, turn), so a conversation with a large share of all
            # turns is spread like any other rows
            user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("example"))
            reply = conv.filter(F.col("role") == "assistant").select(
                "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("counterfactual"))
            side = F.pmod(F.col("conv_id"), F.lit(2)).cast("int")
            made.append(_with_pair_ids(user.join(reply, ["conv_id", "turn"]).select(
                "conv_id", "turn", "example", side.alias("label_ex"), "counterfactual", (1 - side).alias("label_counter"), (F.col("turn") + 1).alias("cf_turn"))))
        return made[0]

    def candidates() -> DataFrame:
        slots = numbered().select("paired_id", "conv_id", "cf_turn", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
        later = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("generated"))
        return (slots.withColumn("turn", F.col("cf_turn") + 1 + F.col("idx")).join(later, on=["conv_id", "turn"], how="left")
                .select("paired_id", F.col("idx").cast("int").alias("idx"), "generated"))

    pairs = bucketed_table(spark, f"pairs_{digest}", lambda: numbered().drop("conv_id"), "paired_id")
    return pairs, bucketed_table(spark, f"candidates_{digest}_{n}", candidates, "paired_id")


def PAIRS_SQL(n: int = N_CANDIDATES) -> str:
    return f"""pairs AS (
  SELECT u.conv_id * {TURNS} + u.turn AS paired_id, u.text AS example, CAST(u.conv_id % 2 AS INTEGER) AS label_ex,
         a.text AS counterfactual, CAST(1 - u.conv_id % 2 AS INTEGER) AS label_counter, a.turn AS cf_turn, u.conv_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
cands AS (
  SELECT p.paired_id, CAST(s.idx AS BIGINT) AS idx, c.text AS generated
  FROM pairs p CROSS JOIN range(0, {n}) s(idx)
  LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.cf_turn + 1 + s.idx)"""


# --- NLI roles ---------------------------------------------------------------------------------
def _label_name(idx_col):
    return F.element_at(F.array(*[F.lit(x) for x in NLI_LABELS]), (idx_col % 3 + 1).cast("int"))


def nli_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_order"), F.concat_ws(":", "lang", "source").alias("premise"),
                    F.col("text").alias("hypothesis"), _label_name(F.col("doc_id")).alias("label"))


def nli_revised_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revised-premise rows: every document (matches itself or an earlier duplicate text) plus
    every benchmark passage (usually no match, so dropped by the inner lookup)."""
    d = table(spark, sf_dir, "documents")
    b = table(spark, sf_dir, "benchmark")
    docs = d.select(F.col("doc_id").alias("rid"), F.concat(F.lit("revised "), F.col("source")).alias("counter_prem"),
                    F.col("text").alias("original_hyp"), _label_name(F.col("doc_id") + 1).alias("counter_label"))
    bench = b.select((F.lit(-1) - F.col("item_id")).alias("rid"), F.lit("revised benchmark").alias("counter_prem"),
                     F.col("text").alias("original_hyp"), _label_name(F.col("item_id")).alias("counter_label"))
    return docs.unionByName(bench)


def nli_revised_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rid"), F.concat_ws(":", "lang", "source").alias("original_prem"),
                    F.concat(F.lit("revised: "), F.col("text")).alias("counter_hyp"),
                    _label_name(F.col("doc_id") + 2).alias("counter_label"))


_LABEL_SQL = "(['entailment','neutral','contradiction'])[({x}) % 3 + 1]"


def NLI_SQL() -> str:
    lab = _LABEL_SQL
    return f"""nli_orig AS (
  SELECT doc_id AS row_order, concat_ws(':', lang, source) AS premise, text AS hypothesis,
         {lab.format(x='doc_id')} AS label FROM documents),
rp_rev AS (
  SELECT doc_id AS rid, 'revised ' || source AS counter_prem, text AS original_hyp,
         {lab.format(x='doc_id + 1')} AS counter_label FROM documents
  UNION ALL
  SELECT -1 - item_id AS rid, 'revised benchmark' AS counter_prem, text AS original_hyp,
         {lab.format(x='item_id')} AS counter_label FROM benchmark),
rh_rev AS (
  SELECT doc_id AS rid, concat_ws(':', lang, source) AS original_prem, 'revised: ' || text AS counter_hyp,
         {lab.format(x='doc_id + 2')} AS counter_label FROM documents),
rp_lookup AS (
  SELECT hypothesis, arg_min(premise, row_order) AS premise, arg_min(label, row_order) AS label
  FROM nli_orig GROUP BY hypothesis),
rh_lookup AS (
  SELECT premise, arg_min(hypothesis, row_order) AS hypothesis, arg_min(label, row_order) AS label
  FROM nli_orig GROUP BY premise),
rp AS (
  SELECT r.rid, l.label AS original_label, r.counter_label, 'RP' AS task, l.premise AS original_prem,
         r.counter_prem, r.original_hyp, '' AS counter_hyp
  FROM rp_rev r JOIN rp_lookup l ON r.original_hyp = l.hypothesis),
rh AS (
  SELECT r.rid, l.label AS original_label, r.counter_label, 'RH' AS task, r.original_prem,
         '' AS counter_prem, l.hypothesis AS original_hyp, r.counter_hyp
  FROM rh_rev r JOIN rh_lookup l ON r.original_prem = l.premise),
nli AS (SELECT * FROM rp UNION ALL SELECT * FROM rh)"""


NLI_COLS = ["rid", "original_label", "counter_label", "task", "original_prem", "counter_prem", "original_hyp", "counter_hyp"]


def nli_pairs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """RP and RH pair rows in one table (U1), each dealt to ``parts`` tasks if given."""
    from flipframe.operators.pairs import revised_hypothesis_pairs, revised_premise_pairs

    orig = nli_original(spark, sf_dir)
    rp = revised_premise_pairs(nli_revised_premises(spark, sf_dir), orig, parts=parts)
    rh = revised_hypothesis_pairs(nli_revised_hypotheses(spark, sf_dir), orig, parts=parts)
    return rp.select(*NLI_COLS).unionByName(rh.select(*NLI_COLS))


def nli_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLI rows over the benchmark passages: premise = a passage, hypothesis = the next one by id, the
    revised side = the one after that; even items revise the premise (RP), odd ones the hypothesis."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    shifted = lambda k, name: b.select((F.col("item_id") - k).alias("item_id"), F.col("text").alias(name))
    rows = b.withColumnRenamed("text", "original_prem").join(shifted(1, "original_hyp"), "item_id").join(shifted(2, "revised"), "item_id")
    rp = F.col("item_id") % 2 == 0
    return rows.select(
        F.col("item_id").alias("rid"), _label_name(F.col("item_id")).alias("original_label"), _label_name(F.col("item_id") + 1).alias("counter_label"),
        F.when(rp, "RP").otherwise("RH").alias("task"), "original_prem", F.when(rp, F.col("revised")).otherwise("").alias("counter_prem"),
        "original_hyp", F.when(rp, "").otherwise(F.col("revised")).alias("counter_hyp"))


def NLI_SHORT_SQL() -> str:
    lab = _LABEL_SQL
    return f"""nli_s AS (
  SELECT a.item_id AS rid, {lab.format(x='a.item_id')} AS original_label, {lab.format(x='a.item_id + 1')} AS counter_label,
         CASE WHEN a.item_id % 2 = 0 THEN 'RP' ELSE 'RH' END AS task, a.text AS original_prem,
         CASE WHEN a.item_id % 2 = 0 THEN c.text ELSE '' END AS counter_prem, b.text AS original_hyp,
         CASE WHEN a.item_id % 2 = 0 THEN '' ELSE c.text END AS counter_hyp
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 JOIN benchmark c ON c.item_id = a.item_id + 2)"""
