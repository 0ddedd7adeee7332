"""Small tables with awkward rows."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string"
LONG = "word " * 40_000 + "end"


def docs(spark, rows):
    """Documents with extra columns named like results; rows are (doc_id, text[, source])."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None, "extra", "extra", "extra") for r in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, "one two three four five"), (2, None), (3, ""), (4, "  \t\n "), (5, LONG), (6, "one two three four five"),
    (6, "one two three four five"), (None, "one two three four five"), (7, "Ünï çödé 漢字 🙂 \\ </s>", None), (8, LONG, "b"), (9, "x"),
    (None, None, None),
]
