"""Corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, BPE.

Each stage works on all that its predecessor kept; the result of each is written as Parquet in
the shared folder and reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flipframe.llm.bpe_automaton import encode_texts
from flipframe.llm.common import table, written
from flipframe.llm.covering_simhash import keep_one_each
from flipframe.llm.quality_gam import keep_good
from flipframe.llm.wu_manber import keep_uncontaminated


def tokenizer_path() -> str:
    """The byte-level BPE file that the encoding stage and query use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each SimHash group stays, the one with the smallest id."""
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in which a benchmark window occurs go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids, with the digests of the ids and of the text decoded from them."""
    return encode_texts(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The quality model and SimHash have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per kept document.

    Null and empty texts are judged like any others; of equal fingerprints the smallest id stays, and
    rows that repeat it count as one document; extra columns travel on, whatever their names; an empty
    table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
