"""Language-modelling corpora: vocabulary ids, fixed-length blocks, masking, bigram perplexity.

Token positions across the whole corpus stream are a distributed prefix sum over per-line token
counts (``positions.running_totals``).  Vocabulary lookups are joins, never per-token map scans.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.functions.order import TWO_POW_32, hash_key, uniform01
from flipframe.functions.text import word_tokens
from flipframe.session import bucketed_table, scratch_table, shuffle_partitions

# --- fixed values -------------------------------------------------------------------------
SPECIAL_IDS = {"<|PAD|>": 0, "<|UNK|>": 1, "<|BOS|>": 2, "<|EOS|>": 3, "<|SEP|>": 4, "<|MASK|>": 5}
IGNORE_INDEX = -100
MLM_PROBABILITY = 0.15
MASK_SHARE = 0.8          # of the selected positions: replaced by the mask id
RANDOM_SHARE = 0.1        # of the selected positions: replaced by a random id (rest unchanged)
# ------------------------------------------------------------------------------------------


def tokenize_lines(lines: DataFrame, id_col: str = "line_id", text_col: str = "text") -> DataFrame:
    """(line_id, tokens): the one tokenisation pass every later corpus step reads."""
    return lines.select(id_col, word_tokens(text_col).alias("tokens"))


def build_vocab(tokens: DataFrame, vocab_size: int | None = None, tokens_col: str = "tokens") -> DataFrame:
    """(token, id): tokens by frequency (ties by token), ids after the specials.

    All tokens by default, else the ``vocab_size`` most frequent.  A limited vocabulary first drops
    every token below the frequency at which the histogram of frequencies reaches the limit (about
    sqrt(2 * number of tokens) distinct values); the survivors get their global position.
    """
    from flipframe.operators.positions import global_position

    counts = (tokens.select(F.explode(tokens_col).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    if vocab_size is not None:
        counts = scratch_table(counts, "token-counts")
        before = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)
        hist = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(before), F.lit(0)))
        least = hist.filter(F.col("_b") < vocab_size).agg(F.min("freq").alias("_least"))
        counts = counts.crossJoin(F.broadcast(least)).filter(F.col("freq") >= F.col("_least")).drop("_least")  # one row
    r = global_position(counts, [F.desc("freq"), F.asc("token")], "_rank")
    if vocab_size is not None:
        r = r.filter(F.col("_rank") < vocab_size)
    return r.select("token", (F.col("_rank") + len(SPECIAL_IDS)).cast("int").alias("id"))


def encode_lines(tokens: DataFrame, vocab: DataFrame, id_col: str = "line_id", tokens_col: str = "tokens") -> DataFrame:
    """(line_id, pos, id) long form: every token mapped through the vocabulary, unknown -> UNK.

    A plain join: AQE broadcasts a vocabulary that it measures as small and splits the partitions
    of very frequent tokens otherwise.
    """
    toks = tokens.select(id_col, F.posexplode(tokens_col).alias("pos", "token"))
    return (toks.join(vocab, on="token", how="left")
            .select(id_col, "pos", F.coalesce(F.col("id"), F.lit(SPECIAL_IDS["<|UNK|>"])).cast("int").alias("id")))


def ids_arrays(encoded: DataFrame, id_col: str = "line_id") -> DataFrame:
    """Long (line_id, pos, id) back to one ordered id array per line.

    Position and id travel as one long (ids are non-negative ints, positions within a line fit 31
    bits), so the gather collects and sorts a primitive array.
    """
    packed = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("id").cast("long")
    return (encoded.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(packed)).alias("_p"))
            .select(id_col, F.transform("_p", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("ids")))


LOT_TOKENS = 1 << 21  # tokens of a lot, about: what one task encodes at a time


def encode_arrays(tokens: DataFrame, vocab: DataFrame, id_col: str = "line_id", tokens_col: str = "tokens") -> DataFrame:
    """(line_id, ids): :func:`ids_arrays` of :func:`encode_lines`, without a row per token.

    Lines are dealt to lots by their id.  Each lot's distinct tokens meet the vocabulary in a join, and
    the lot's lines meet that word list in an Arrow batch, so what is shuffled is the text of
    the lines and the word lists.  Lines that repeat an id become one, by position and id.
    """
    spark = tokens.sparkSession
    total = tokens.agg(F.sum(F.size(tokens_col))).first()[0] or 0
    n = shuffle_partitions(spark)
    lots = max(2 * n, -(-int(total) // LOT_TOKENS))
    # no token holds a blank, so a line's tokens travel as one string
    lines_by_lot = tokens.where(F.size(tokens_col) > 0).select(F.pmod(F.xxhash64(id_col), F.lit(lots)).cast("int").alias("lot"),
                                                               F.col(id_col), F.array_join(tokens_col, " ").alias("line"))
    lines = bucketed_table(spark, f"lots_{uuid.uuid4().hex[:12]}", lambda: lines_by_lot, "lot")  # neither side below shuffles it again
    words = lines.select(F.col("lot").alias("_lot"), F.explode(F.split("line", " ")).alias("token")).distinct().join(vocab, on="token", how="left")
    words = words.select("_lot", "token", F.coalesce(F.col("id"), F.lit(SPECIAL_IDS["<|UNK|>"])).cast("int").alias("id"))

    def encode(part: pa.Table, known: pa.Table) -> pa.Table:
        key, text = part.column(id_col).combine_chunks(), part.column("line").combine_chunks()
        words_of = pc.split_pattern(text, " ")
        at = pc.index_in(words_of.flatten(), value_set=known.column("token").combine_chunks())
        ids = known.column("id").combine_chunks().take(at)
        offsets = words_of.offsets
        if pc.count_distinct(key, mode="all").as_py() < len(key):
            code = pc.dictionary_encode(key, null_encoding="encode")
            size = np.diff(offsets.to_numpy())
            row = np.repeat(code.indices.to_numpy(), size)
            pos = np.arange(len(ids)) - np.repeat(offsets.to_numpy()[:-1], size)
            ids = ids.take(pa.array(np.lexsort((ids.to_numpy(), pos, row))))
            key, offsets = code.dictionary, pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(code.dictionary)))]), pa.int32())
        return pa.table({id_col: key, "ids": pa.ListArray.from_arrays(offsets, ids)})

    spec = T.StructType([tokens.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return lines.groupBy("lot").cogroup(words.groupBy("_lot")).applyInArrow(encode, spec)


def line_offsets(tokens: DataFrame, id_col: str = "line_id", tokens_col: str = "tokens") -> DataFrame:
    """(line_id, n_tokens, start): the first stream position of every line, lines in id order."""
    from flipframe.operators.positions import in_ranges, running_totals

    sized = tokens.select(id_col, F.size(tokens_col).cast("long").alias("n_tokens"))
    ranged = in_ranges(sized, [id_col])
    starts = running_totals(ranged, [id_col], F.col("n_tokens"), "start")
    return starts.select(id_col, "n_tokens", F.col("start").cast("long").alias("start"))


def _div(x: Column, n: int) -> Column:
    """Exact integer quotient of a non-negative long (the remainder goes first: a rounded quotient could step over a border)."""
    return ((x - F.pmod(x, F.lit(int(n)).cast("long"))) / F.lit(int(n))).cast("long")


def pack_blocks(ids: DataFrame, offsets: DataFrame, block_size: int, id_col: str = "line_id",
                bos_id: int | None = None, eos_id: int | None = None) -> DataFrame:
    """Cut the corpus stream into blocks of ``block_size`` ids; the last partial block is dropped.

    ``ids`` has one id array per line (:func:`ids_arrays`).  Each array is cut at block borders
    into at most ``length / block_size + 2`` slices; a block gathers its slices, ordered by their
    offset inside the block, and concatenates them.
    """
    size = F.lit(int(block_size)).cast("long")
    total = offsets.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_total"))
    lines = ids.join(offsets.select(id_col, "start", "n_tokens").filter("n_tokens > 0"), on=id_col)
    last = F.col("start") + F.col("n_tokens") - 1
    cut = lines.select("ids", "start", "n_tokens", F.explode(F.sequence(_div(F.col("start"), block_size), _div(last, block_size))).alias("block_id"))
    begin = F.greatest(F.col("block_id") * size - F.col("start"), F.lit(0))
    end = F.least((F.col("block_id") + 1) * size - F.col("start"), F.col("n_tokens"))
    part = F.struct((F.col("start") + begin - F.col("block_id") * size).cast("int").alias("at"),
                    F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))
    blocks = (cut.select("block_id", part.alias("_part")).crossJoin(F.broadcast(total))  # one row
              .filter((F.col("block_id") + 1) * size <= F.col("_total"))
              .groupBy("block_id").agg(F.sort_array(F.collect_list("_part")).alias("_p"))
              .select("block_id", F.flatten("_p.ids").alias("ids")))
    if bos_id is not None:
        blocks = blocks.withColumn("ids", F.concat(F.array(F.lit(bos_id)), "ids"))
    if eos_id is not None:
        blocks = blocks.withColumn("ids", F.concat("ids", F.array(F.lit(eos_id))))
    return blocks


def mlm_mask(blocks: DataFrame, seed, vocab_max_id: int | Column, id_col: str = "block_id", ids_col: str = "ids",
             special_ids=tuple(SPECIAL_IDS.values()), mask_id: int = SPECIAL_IDS["<|MASK|>"]) -> DataFrame:
    """Masked-LM inputs/labels from a per-position hash (no shuffle, partitioning-independent).

    A non-special position is selected with probability 0.15; selected positions become the mask
    id (80 %), a random id (10 %) or stay (10 %); labels keep the original id only where selected.
    ``vocab_max_id`` may be a column of ``blocks``.
    """
    vocab_max_id = vocab_max_id if isinstance(vocab_max_id, Column) else F.lit(vocab_max_id)
    special = F.array(*[F.lit(i) for i in special_ids])
    least = f"{math.ceil(MLM_PROBABILITY * TWO_POW_32):08x}"  # a smaller key is a number below the probability

    def u(pos, salt):
        return uniform01(hash_key(f"{seed}/{salt}", F.col(id_col), pos))

    def chosen(x, i):
        return (~F.array_contains(special, x)) & (hash_key(f"{seed}/sel", F.col(id_col), i) < least)

    def masked(x, i):
        band = u(i, "band")
        rnd = F.floor(u(i, "rnd") * (vocab_max_id + 1)).cast("int")  # any id of the vocabulary
        return (F.when(~F.get("_chosen", i), x).when(band < MASK_SHARE, F.lit(mask_id))
                .when(band < MASK_SHARE + RANDOM_SHARE, rnd).otherwise(x))

    # two readers of the flags: they are computed once a position
    flagged = blocks.withColumn("_chosen", F.transform(ids_col, chosen))
    return flagged.select(id_col, F.transform(ids_col, masked).alias("input_ids"),
                          F.zip_with(ids_col, "_chosen", lambda x, c: F.when(c, x).otherwise(F.lit(IGNORE_INDEX))).alias("labels"))


def bigram_table(train_lines: DataFrame, text_col: str = "text") -> DataFrame:
    toks = train_lines.select(F.concat(F.array(F.lit("<s>")), word_tokens(text_col)).alias("t"))
    grams = toks.select(F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("w1"),
                                              F.slice("t", 2, F.size("t")).alias("w2"))).alias("z"))
    return grams.groupBy(F.col("z.w1").alias("w1"), F.col("z.w2").alias("w2")).agg(F.count(F.lit(1)).alias("c12"))


def bigram_token_nll(train_lines: DataFrame, heldout: DataFrame, id_col: str, text_col: str = "text",
                     k: float = 1.0) -> DataFrame:
    """Held-out negative log-likelihoods under an add-k bigram model of the training lines:
    (id, nll, n), one row per distinct bigram of an item, which occurs ``n`` times in it.

    The training counts are written once and read for the bigrams, the first words and the
    vocabulary size.  Held-out bigrams are counted before they meet the model, so a frequent first
    word brings at most as many rows as it has distinct successors per item.
    """
    bi = scratch_table(bigram_table(train_lines, text_col), "bigrams")
    uni = bi.groupBy("w1").agg(F.sum("c12").alias("c1"))
    size = bi.agg((F.countDistinct("w2") + 1).alias("_v"))
    toks = heldout.select(id_col, F.concat(F.array(F.lit("<s>")), word_tokens(text_col)).alias("t"))
    hg = toks.select(id_col, F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("w1"),
                                                    F.slice("t", 2, F.size("t")).alias("w2"))).alias("z"))
    hg = hg.groupBy(id_col, F.col("z.w1").alias("w1"), F.col("z.w2").alias("w2")).agg(F.count(F.lit(1)).alias("n"))
    pairs = hg.select("w1", "w2").distinct().join(bi, on=["w1", "w2"], how="left").join(uni, on="w1", how="left")
    pairs = pairs.crossJoin(F.broadcast(size))  # one row
    p = (F.coalesce(F.col("c12"), F.lit(0)) + F.lit(k)) / (F.coalesce(F.col("c1"), F.lit(0)) + F.lit(k) * F.col("_v"))
    return hg.join(pairs.select("w1", "w2", (-F.log(p)).alias("nll")), on=["w1", "w2"]).select(id_col, "nll", "n")
