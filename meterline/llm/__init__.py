"""Operations on training data for language models, and their registered queries."""

from meterline.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
