"""Text generation by decoding a next-token table: beam search and seeded sampling.

The model is a table of token successions counted in a corpus, one row per (group, token) with its
most frequent successors: ``top_k`` of them, cut to the smallest head that holds the share ``top_p``.
Groups are classes of texts (such as a sentiment), so a prompt is continued in the words of the class
that it asks for.

Decoding keeps a frontier table of hypotheses.  A step joins every open hypothesis with the successors of its
last token, drops successors that are not allowed, and keeps the best ``beams`` hypotheses of each prompt
by a window, or draws one successor per hypothesis.  Draws hash (seed, id, candidate, step), so they
depend on nothing else.  A hypothesis ends with the end token, at its length budget, or where no successor is
allowed.  Scores are sums of log-probabilities in whole millionths, so equal
scores are equal in any order of summation; hypotheses compare by score per scored token, equal ones by their tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.functions.order import hash_key, uniform01
from flipframe.functions.text import word_tokens
from flipframe.functions.util import as_col
from flipframe.session import scratch_table

# the tokeniser splits these at their brackets, so no text has them as tokens
START, END = "<s>", "</s>"
MICRO = 1_000_000
CUT_EVERY = 4  # steps between written frontiers


@dataclass(frozen=True)
class Decoding:
    """Settings of a generation, as the generator's configuration names them."""

    n: int = 3  # candidates per prompt
    beams: int = 2
    min_length: int = 5  # tokens before the end token is allowed
    no_repeat_ngram: int = 0  # no n-gram of this size occurs twice; 0: any may
    penalty: float = 1.0  # log-probability factor of tokens that already occur
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 1.0
    seed: str = "generate"


def next_tokens(texts: DataFrame, text_col: str, by: Sequence[str], s: Decoding) -> DataFrame:
    """(by, prev, total, succ): the count of each token and its kept successors, an array of (token, c, p) by falling
    count; c is the successor's count, p its weight under the temperature."""
    by = list(by)
    toks = F.concat(F.array(F.lit(START)), word_tokens(text_col), F.array(F.lit(END)))
    rows = texts.where(F.col(text_col).isNotNull()).select(*by, toks.alias("t"))
    n = F.size("t") - 1
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("prev"), F.slice("t", F.lit(2), n).alias("token"))
    pair = rows.select(*by, F.explode(pairs).alias("q")).select(*by, F.col("q.prev").alias("prev"), F.col("q.token").alias("token"))
    counts = scratch_table(pair.groupBy(*by, "prev", "token").agg(F.count(F.lit(1)).alias("c")), "successions")
    totals = counts.groupBy(*by, "prev").agg(F.sum("c").alias("total"))
    order = Window.partitionBy(*by, "prev").orderBy(F.desc("c"), "token")
    top = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= s.top_k)  # limited before the shuffle too
    weight = F.col("c").cast("double") if s.temperature == 1 else F.pow(F.col("c").cast("double"), F.lit(1.0 / s.temperature))
    every = Window.partitionBy(*by, "prev")
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    head = top.withColumn("p", weight).withColumn("before", before).withColumn("all", F.sum("p").over(every)).where(F.col("before") < s.top_p * F.col("all"))
    rows = head.groupBy(*by, "prev").agg(F.sort_array(F.collect_list(F.struct("nth", "token", "c", "p"))).alias("s"))  # at most top_k
    succ = F.transform("s", lambda e: F.struct(e["token"].alias("token"), e["c"].alias("c"), e["p"].alias("p")))
    return scratch_table(rows.join(totals, [*by, "prev"]).select(*by, "prev", "total", succ.alias("succ")), "next-tokens")


def _repeats(history: Column, token: Column, n: int) -> Column:
    """Whether ``token`` would complete an n-gram that ``history`` holds already."""
    if n <= 0:
        return F.lit(False)
    size = F.size(history)
    gram = F.concat(F.slice(history, size - n + 2, F.lit(n - 1)), F.array(token)) if n > 1 else F.array(token)
    met = F.exists(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice(history, i, F.lit(n)) == gram)
    return F.when(size >= n, met).otherwise(False)


def _started(prompts: DataFrame, table: DataFrame, by: list[str], seed_col: str) -> DataFrame:
    """Prompts with the token that generation goes on from: the seed's last one, or the start where the
    table has no successor of it."""
    last = F.element_at(F.col(seed_col), -1)
    p = prompts.withColumn("prev", F.when(F.size(seed_col) > 0, last).otherwise(F.lit(START)))
    known = table.select(*by, "prev", F.lit(True).alias("known"))
    return p.join(known, [*by, "prev"], "left").withColumn("prev", F.when(F.col("known"), F.col("prev")).otherwise(F.lit(START))).drop("known")


def _allowed(s: Decoding) -> Column:
    history = F.concat("seed", "tokens")
    return F.filter("succ", lambda e: ~((e["token"] == END) & (F.size("tokens") < s.min_length)) & ~_repeats(history, e["token"], s.no_repeat_ngram))


def beam_search(prompts: DataFrame, table: DataFrame, s: Decoding, by: Sequence[str], id_col: str = "id", seed_col: str = "seed",
                budget_col: str = "budget", max_steps: int = 1024) -> DataFrame:
    """(id, idx, generated, score): the ``n`` best hypotheses of each prompt, idx 0 the best; null where there
    are fewer.  ``seed`` holds the prompt's tokens, ``budget`` the most tokens to generate."""
    by = list(by)
    base = _started(prompts.select(F.col(id_col).alias("id"), *by, F.col(seed_col).alias("seed"), F.col(budget_col).alias("budget")), table, by, "seed")
    front = base.select("*", F.array().cast("array<string>").alias("tokens"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("scored"),
                        (F.col("budget") <= 0).alias("done"))
    cols = front.columns
    better = Window.partitionBy("id").orderBy(F.desc(F.col("score") / F.greatest(F.col("scored"), F.lit(1))), "tokens")
    width = max(s.beams, s.n)
    history = F.concat("seed", "tokens")
    for step in range(1, max_steps + 1):
        open_ = front.where(~F.col("done")).join(table, [*by, "prev"], "left").withColumn("ok", _allowed(s))

        def gain(e):
            w = F.round(F.log(e["c"] / F.col("total")) * MICRO).cast("long")
            if s.penalty != 1:
                w = F.when(F.array_contains(history, e["token"]), F.round(w * s.penalty).cast("long")).otherwise(w)
            return F.struct(e["token"].alias("token"), w.alias("w"))

        stuck = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("w")))
        moves = F.when(F.coalesce(F.size("ok"), F.lit(0)) > 0, F.transform("ok", gain)).otherwise(stuck)
        moved = open_.select(*cols, F.explode(moves).alias("e"))
        ends = F.col("e.token").isNull() | (F.col("e.token") == END)
        tokens = F.when(ends, F.col("tokens")).otherwise(F.concat("tokens", F.array("e.token")))
        moved = moved.select(
            "id", *by, "seed", "budget", F.when(ends, F.col("prev")).otherwise(F.col("e.token")).alias("prev"), tokens.alias("tokens"),
            (F.col("score") + F.col("e.w")).alias("score"), (F.col("scored") + F.col("e.token").isNotNull().cast("int")).alias("scored"),
            (ends | (F.size(tokens) >= F.col("budget"))).alias("done"),
        )
        front = moved.unionByName(front.where("done")).withColumn("nth", F.row_number().over(better)).where(F.col("nth") <= width).select(*cols)
        if step % CUT_EVERY == 0:
            front = scratch_table(front, "frontier")
            if front.where(~F.col("done")).isEmpty():
                break
    best = front.withColumn("idx", F.row_number().over(better) - 1).where(F.col("idx") < s.n)
    slots = base.select("id", F.explode(F.sequence(F.lit(0), F.lit(s.n - 1))).alias("idx"))
    return slots.join(best, ["id", "idx"], "left").select("id", "idx", F.array_join(F.concat("seed", "tokens"), " ").alias("generated"), "score")


def sample(prompts: DataFrame, table: DataFrame, s: Decoding, by: Sequence[str], id_col: str = "id", seed_col: str = "seed",
           budget_col: str = "budget", max_steps: int = 1024) -> DataFrame:
    """(id, idx, generated): ``n`` drawn continuations of each prompt."""
    by = list(by)
    base = _started(prompts.select(F.col(id_col).alias("id"), *by, F.col(seed_col).alias("seed"), F.col(budget_col).alias("budget")), table, by, "seed")
    front = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.n - 1))).alias("idx"), F.array().cast("array<string>").alias("tokens"),
                        (F.col("budget") <= 0).alias("done"))
    cols = front.columns
    history = F.concat("seed", "tokens")
    for step in range(1, max_steps + 1):
        # finished hypotheses stay in the table: the step is one left join and no shuffle by prompt
        at = front.join(table, [*by, "prev"], "left").withColumn("ok", _allowed(s))

        def weight(e):
            if s.penalty == 1:
                return e["p"]
            again = F.pow(e["c"] / F.col("total"), F.lit(s.penalty / s.temperature))
            once = F.pow(e["c"] / F.col("total"), F.lit(1.0 / s.temperature))
            return F.when(F.array_contains(history, e["token"]), again).otherwise(once)

        at = at.withColumn("ok", F.transform("ok", lambda e: F.struct(e["token"].alias("token"), weight(e).alias("p"))))
        at = at.withColumn("goal", F.aggregate("ok", F.lit(0.0), lambda a, e: a + e["p"]) * uniform01(hash_key(s.seed, "id", "idx", F.lit(step))))
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))
        drawn = F.aggregate("ok", first, lambda a, e: F.struct(
            (a["sum"] + e["p"]).alias("sum"), F.when(a["pick"].isNull() & (a["sum"] + e["p"] > F.col("goal")), e["token"]).otherwise(a["pick"]).alias("pick")))["pick"]
        at = at.withColumn("pick", F.when(~F.col("done"), drawn))
        ends = F.col("pick").isNull() | (F.col("pick") == END)
        tokens = F.when(ends, F.col("tokens")).otherwise(F.concat("tokens", F.array("pick")))
        front = at.select("id", *by, "seed", "budget", F.when(ends, F.col("prev")).otherwise(F.col("pick")).alias("prev"), "idx", tokens.alias("tokens"),
                          (F.col("done") | ends | (F.size(tokens) >= F.col("budget"))).alias("done")).select(*cols)
        if step % CUT_EVERY == 0:
            front = scratch_table(front, "frontier")
            if front.where(~F.col("done")).isEmpty():
                break
    return front.select("id", "idx", F.array_join(F.concat("seed", "tokens"), " ").alias("generated"))


def seeded_prompts(pairs: DataFrame, id_col: str, example_col: str, label_col: str, words: int = 2, longest: int = 1024) -> DataFrame:
    """(id, label, seed, budget): the example's first words as seed, at most twice its length in tokens."""
    t = word_tokens(F.coalesce(as_col(example_col), F.lit("")))
    return pairs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.slice(t, 1, words).alias("seed"),
                        F.least(2 * F.size(t), F.lit(longest)).alias("budget"))
