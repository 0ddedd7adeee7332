"""From raw documents to packed sequences: toxicity, exact copies, near copies, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import exact, mixing, nearcopies, packing, toxicity
from meterline.llm.settings import cycling_weights, is_held_out, tokenizer_path
from meterline.llm.shared import own, table
from meterline.session import stored


def sealed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows as one column beside those the operators read, so that no name of theirs can clash."""
    row = own("row")
    return docs.select(F.struct(*docs.columns).alias(row), "doc_id", "text", "source"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the lexicon doesn't reject. It is learnt from the labels that aren't held out."""
    rows, row = sealed(docs)
    lexicon = toxicity.learn(rows, table(spark, sf_dir, "labels").where(~is_held_out()))
    return toxicity.scored(rows, lexicon, carry=[row]).where("predicted = 0").select(f"{row}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    rows, row = sealed(docs)
    return exact.exact_duplicates(rows, carry=[row]).where("kept").select(f"{row}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Near copies have SimHash fingerprints at three bits or fewer, as in op3, or five-word shingles alike by 0.8 or more.
    """
    rows, row = sealed(docs)
    return nearcopies.near_copies(rows, carry=[row]).where("kept").select(f"{row}.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents the mix leaves out go."""
    rows, row = sealed(docs)
    mixed = mixing.mix(rows, cycling_weights, carry=[row]).where("repeats > 0")
    return mixed.select(row, F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select(f"{row}.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 4,096 tokens."""
    return packing.pack(docs, tokenizer_path)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Scores, fingerprints and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
