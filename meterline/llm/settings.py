"""Production parameters that queries and pipeline share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    """Found where it runs, so that each executor takes its own installed file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, for the sources in code-point order, a missing one last.

    The frame has one row per source; numbering them needs their order and nothing of the documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
