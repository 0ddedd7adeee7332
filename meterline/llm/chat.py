"""Chat formatting: one example per assistant turn, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template, and the control strings that texts must not hold unescaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?INST\]|<</?SYS>>"
_BEFORE_CONTROL = r"(<(?=\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BEFORE_CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """What ``escape`` was given: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trainable: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Prefix-target expansion: ``conv_id, example, n_examples, formatted, loss_start, loss_chars``.

    Every trainable turn gives an example: all turns of its conversation up to it, of which only its
    text is under the loss mask, ``loss_chars`` code points from the 0-based ``loss_start`` on.
    Turns behind the last trainable one give a last example with an empty mask, so that no
    turn is lost. A turn reads ``<|turn|>role<|text|>text<|end|>`` with role and text escaped.

    Rows go by turn, then role, then text, missing turns first; rows that repeat are turns of their
    own. Missing roles and texts are empty. Rows without a conversation form one together. An empty
    table gives no rows. Other columns are not read, so their names may be anything. The longest
    example holds the whole conversation, hence a conversation is gathered in one row.
    """
    piece = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = turns.select(F.col(conv).alias("conv_id"), piece.alias("piece")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"))
    marked = talks.select(
        "conv_id", F.transform("pieces", lambda p: F.struct(
            F.concat(F.lit(TURN), escape(p["role"]), F.lit(TEXT)).alias("head"),
            escape(p["text"]).alias("body"),
            p["role"].isin(*trainable).alias("reply"),
        )).alias("turns"))
    measured = marked.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("all"),
        F.transform("turns", lambda t: F.struct(
            (F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("chars"),
            F.length(t["body"]).alias("body"), t["reply"].alias("reply"))).alias("sizes"),
    )
    ends = F.transform("sizes", lambda s, i: F.struct(
        F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("end"),
        F.when(s["reply"], s["body"]).otherwise(0).cast("long").alias("loss"),
        (s["reply"] | (i + 1 == F.size("sizes"))).alias("ends_example"),
    ))
    examples = measured.select("conv_id", "all", F.filter(ends, lambda e: e["ends_example"]).alias("ends"))
    return examples.select(
        "conv_id", "all", F.size("ends").cast("long").alias("n_examples"), F.posexplode("ends").alias("at", "e"),
    ).select(
        "conv_id", (F.col("at") + 1).cast("long").alias("example"), "n_examples",
        F.substr(F.col("all"), F.lit(1), F.col("e.end").cast("int")).alias("formatted"),
        (F.col("e.end") - len(END) - F.col("e.loss")).alias("loss_start"),
        F.col("e.loss").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: ``conv_id, n_turns, turns, loss, formatted_chars``.

    ``turns`` is role, line feed, text, line feed per turn, parsed from the longest example; ``loss``
    is all text under the masks in order, unescaped; ``formatted_chars`` sums over the examples.
    """
    parts = F.split("formatted", r"<\|turn\|>", -1)
    turns = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(
        unescape(F.substring_index(p, TEXT, 1)), F.lit("\n"),
        unescape(F.substr(
            p, F.length(F.substring_index(p, TEXT, 1)) + len(TEXT) + 1,
            F.length(p) - F.length(F.substring_index(p, TEXT, 1)) - len(TEXT) - len(END))),
        F.lit("\n")))
    longest = F.col("example") == F.col("n_examples")
    each = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(longest, F.size(parts) - 1).cast("long").alias("n_turns"),
        F.when(longest, F.array_join(turns, "")).alias("turns"),
        unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
        .alias("loss"),
    )
    return each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns").alias("turns"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
