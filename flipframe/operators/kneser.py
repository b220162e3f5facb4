"""Back-off language model: interpolated Kneser-Ney of any order, as aggregates over n-gram types.

Only the highest order is counted in the corpus.  A lower order's count of a gram is the number of
distinct grams one longer that end in it, so each order is an aggregate over the types of the one
above, which shrink from order to order.  An order's discount comes from its grams that count once and
twice.  A gram's probability is what is left of its discounted share of its context, plus the context's
freed mass times the probability of the shorter gram; the unigrams are mixed with an even share of the
vocabulary and one unknown word.

The corpus is counted in one pass from the highest order down to word pairs, as packed tries that meet by their
last two words (``operators/tries.py``); only pairs and words are written, with how many grams of each higher
order count once and twice.  The higher orders' grams are
needed only where their context occurs in the held-out texts.  A gram's context is cut from its own
words, and every higher order's context ends in that of the trigrams, so one more pass over the corpus
keeps the grams with such a context, whole, before they are counted.

Held-out grams are counted before they meet the model, and the model's tables are cut to the grams and
contexts that occur there by semi-joins, so the whole model is scanned but never joined out.  The cuts
are broadcast while the held-out grams are few; beyond that they are left to Spark.

Texts are padded with start tokens and end with an end token, which is predicted too.  Null texts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens
from flipframe.operators.tries import tail_pairs
from flipframe.session import scratch_table, shuffle_partitions, shuffles_dropped, spread

START, END = "<s>", "</s>"
DISCOUNT = 0.75  # of an order without grams that count once
WRITTEN = 2  # highest order whose grams are all written
BROADCAST_BYTES = 16 << 20  # of the distinct held-out grams


def grams(texts: DataFrame, text_col: str, order: int, keep: list[str] | None = None, near: int = 1) -> DataFrame:
    """(keep.., gram, near): every gram of ``order`` tokens that ends in a word or the end token, joined by blanks,
    and the context of its last ``near`` tokens."""
    keep = keep or []
    pad = [F.lit(START)] * (order - 1)
    toks = F.concat(F.array(*pad).cast("array<string>"), word_tokens(text_col), F.array(F.lit(END)))
    rows = texts.where(F.col(text_col).isNotNull()).select(*keep, toks.alias("t"))
    n = F.size("t") - (order - 1)
    z = F.arrays_zip(*[F.slice("t", F.lit(k + 1), n).alias(f"t{k}") for k in range(order)])
    words = lambda *at: F.concat_ws(" ", *[F.col(f"z.t{k}") for k in range(*at)])
    return rows.select(*keep, F.explode(z).alias("z")).select(*keep, words(order).alias("gram"), words(order - near, order - 1).alias("near"))


def context(gram: Column, order: int) -> Column:
    """The gram of ``order`` tokens without its last one."""
    return F.substring_index(gram, " ", order - 1)


def counts(rows: DataFrame) -> DataFrame:
    """(gram, c) of rows (gram)."""
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))


def shorter(table: DataFrame, order: int) -> DataFrame:
    """(gram, c): the grams of ``order`` tokens that end the given ones, each counting those."""
    return table.withColumn("gram", F.substring_index("gram", " ", -order)).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))


def written(table: DataFrame, name: str) -> DataFrame:
    """``table`` written and read back; the shuffles that made it go at once."""
    with shuffles_dropped(table.sparkSession):
        return scratch_table(table, name)


def train(texts: DataFrame, text_col: str = "text", order: int = 4) -> list[dict]:
    """One dict per order, shortest first: order, discount and grams (gram, c).

    Of the orders above ``WRITTEN``, grams are rows (gram, near) of the highest order, not yet counted.
    """
    spark, low = texts.sparkSession, min(order, WRITTEN)
    if order > WRITTEN:
        corpus = grams(spread(texts.select(text_col)), text_col, order, near=WRITTEN + 1)
        table = tail_pairs(texts, text_col, order, START, END)
    else:
        corpus = grams(texts.select(text_col).repartition(shuffle_partitions(spark)), text_col, order, near=order)
        table = counts(corpus)
    tallied = [c for c in table.columns if c not in ("gram", "c")]
    table = written(table, f"grams-{low}")
    out, above = [], table.agg(*[F.sum(c).alias(c) for c in tallied]).first().asDict() if tallied else {}
    for k in range(order, 0, -1):
        if k > low:
            one, two = above[f"one{k}"], above[f"two{k}"]
        else:
            if k < low:
                table = written(shorter(table, k), f"grams-{k}")
            one, two = table.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        discount = one / (one + 2 * two) if one else DISCOUNT
        out.append({"order": k, "grams": corpus if k > low else table.select("gram", "c"), "discount": discount})
    return out[::-1]


def token_losses(model: list[dict], held_out: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, nll, n): negative log-likelihood of each distinct gram of an item, which occurs ``n`` times in it."""
    order = len(model)
    met = grams(held_out, text_col, order, [id_col]).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("n"))
    met = written(met, "held-out-grams")
    rows = written(met.select("gram").distinct(), "held-out-types")
    size = rows.agg(F.sum(F.octet_length("gram"))).first()[0] or 0
    tail = lambda k: F.substring_index("gram", " ", -k)

    def cut(table: DataFrame, col: Column, key: Column) -> DataFrame:
        """The rows of ``table`` whose ``col`` is a ``key`` of a held-out gram."""
        keys = rows.select(key.alias("_key")).distinct()
        return table.withColumn("_key", col).join(F.broadcast(keys) if size <= BROADCAST_BYTES else keys, "_key", "left_semi").drop("_key")

    tables = {m["order"]: m["grams"] for m in model}
    for k in range(order, WRITTEN, -1):
        whole = counts(cut(tables[k], F.col("near"), context(tail(WRITTEN + 1), WRITTEN + 1))) if k == order else shorter(tables[k + 1], k)
        tables[k] = written(whole, f"near-{k}")
    rows = rows.withColumn("p", F.lit(None).cast("double"))
    for m in model:
        k, d = m["order"], F.lit(m["discount"])
        near = tables[k] if k == 1 else cut(tables[k], context(F.col("gram"), k), context(tail(k), k))
        near = written(near, f"near-{k}") if 1 < k <= WRITTEN else near  # two cuts read it
        seen = cut(near, F.col("gram"), tail(k)).select(F.col("gram").alias("g"), "c")
        known = near.groupBy(context(F.col("gram"), k).alias("ctx")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
        rows = rows.withColumn("g", tail(k)).withColumn("ctx", context(F.col("g"), k)).join(seen, "g", "left").join(known, "ctx", "left")
        c, total, types = F.coalesce("c", F.lit(0)), F.col("total"), F.col("types")
        below = 1 / (types + 1) if k == 1 else F.col("p")
        mixed = F.greatest(c - d, F.lit(0.0)) / total + d * types / total * below
        # a context that training never saw hands on to the shorter gram
        rows = rows.select("gram", (mixed if k == 1 else F.when(total.isNull(), F.col("p")).otherwise(mixed)).alias("p"))
    scored = rows.select("gram", (-F.log("p")).alias("nll"))
    return met.join(scored, "gram").select(id_col, "nll", "n")
