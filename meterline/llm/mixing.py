"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.shared import WORD, bounded_broadcast, own, sized, whole
from meterline.session import stored


def words_in(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """``sources`` (``source, source_size, weight``) with ``target``.

    Targets share ``total`` (the sum of all sizes by default) by weight and stop at ``max_epochs``
    times a source's size; what that leaves is shared again by weight among the rest, until no
    target is above. Each round is one sum over the sources, and only that sum comes to the driver.
    Without a weight, or with all sources stopped, the excess stays unshared.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        held, weight, n = sources.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == stopped or not weight:
            break
        # Sources stop in turn and never start again, for the level only rises.
        stopped, level = n, max(level, (total - float(held or 0.0)) / float(weight))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def _cut(rows: DataFrame, wanted: DataFrame, slice_bits: int, n: int, broadcast_rows: int) -> DataFrame:
    """``source, cut``: the largest ``h`` up to which the sizes of a source's rows add up to ``want`` at most.

    ``rows`` has ``source, h, size``. Sums per source and slice of ``h`` are combined before the
    shuffle; only the slice in which a source reaches its want is looked at row by row. ``cut`` is null
    where not even the first row fits. ``wanted`` has ``n`` rows.
    """
    low = 64 - slice_bits
    slice_of = F.shiftright("h", low)
    sums = rows.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("size")).withColumn(
        "upto", F.sum("size").over(Window.partitionBy("source").orderBy("slice")))
    border = sums.alias("s").join(wanted.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).where(
        "s.upto > w.want").groupBy("s.source").agg(
        F.min(F.struct("s.slice", (F.col("s.upto") - F.col("s.size")).alias("before"))).alias("at"),
        F.max("w.want").alias("want"))
    border = bounded_broadcast(stored(sized(border, n), "border"), n, broadcast_rows)
    inside = rows.alias("r").join(
        border.alias("b"),
        F.col("r.source").eqNullSafe(F.col("b.source")) & (F.shiftright("r.h", low) == F.col("b.at.slice")),
    ).select("r.source", "r.h", "r.size", "b.want", "b.at.before", "b.at.slice")
    # Rows of equal h are taken together or not at all, so ties need no order.
    last = inside.withColumn(
        "upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("h")),
    ).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("want"), F.col("h"))).alias("h"), F.min("slice").alias("slice"))
    first = F.col("slice") == -(1 << (slice_bits - 1))
    cuts = last.select("source", F.coalesce(
        "h", F.when(~first, F.shiftleft(F.col("slice").cast("long"), low) - 1)).alias("cut"), F.lit(True).alias("found"))
    # A source whose rows all fit has no such slice.
    return wanted.alias("w").join(
        cuts.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select(
        "w.source", F.when(F.col("c.found"), F.col("c.cut")).otherwise(F.lit((1 << 63) - 1)).alias("cut"))


def mixing_plan(
    documents: DataFrame, weights, max_epochs: float = 3.0, total: float | None = None, rounds: int = 2,
    slice_bits: int = 12, broadcast_rows: int = 100_000,
) -> DataFrame:
    """Per source ``source, source_size, target, whole`` and ``cuts``, the thresholds of the fractional repetition.

    ``documents`` has ``source, h, size``: a seeded hash and the words of each document. ``weights`` maps
    the frame of sources to the same with ``weight``. A row is in the fractional repetition if
    for one of ``cuts`` its size is at most ``limit`` and ``h`` at most ``cut``. The first cut takes documents in the order of ``h`` until the next would pass the want;
    each further one fills the gap from the documents left that still fit. Of the documents of one source
    ``gone`` is none of them and ``last`` one more, if any.
    """
    rows = stored(documents.groupBy("source", "h", "size").agg(F.count("*").alias("n")), "sizes")
    sources = stored(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    n = sources.count()
    sources = stored(sized(weights(sources), n), "weights")
    plan = stored(sized(
        water_fill(sources, max_epochs, total).select(
            "source", "source_size", "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
        ).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")), n), "targets")
    cuts = plan.select("*", F.expr("cast(array() as array<struct<limit:double,cut:bigint>>)").alias("cuts"))
    for _ in range(rounds):
        known = bounded_broadcast(cuts, n, broadcast_rows)
        left = rows.alias("r").join(known.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).where(
            (F.col("r.size") > 0) & (F.col("r.size") <= F.col("p.gap")) & ~taken_by(F.col("p.cuts"), F.col("r.size"), F.col("r.h")),
        ).select("r.source", "r.h", (F.col("r.size") * F.col("r.n")).alias("size"))
        left = stored(left.groupBy("source", "h").agg(F.sum("size").alias("size")), "left")
        found = _cut(left, cuts.select("source", F.col("gap").alias("want")), slice_bits, n, broadcast_rows)
        added = cuts.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source"))).select(
            "p.source", "p.source_size", "p.target", "p.whole",
            F.when(F.col("f.cut").isNull(), F.col("p.cuts")).otherwise(F.concat("p.cuts", F.array(F.struct(
                F.col("p.gap").alias("limit"), F.col("f.cut").alias("cut"))))).alias("cuts"))
        added = stored(sized(added, n), "cuts")
        known = bounded_broadcast(added, n, broadcast_rows)
        took = rows.alias("r").join(known.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).where(
            taken_by(F.col("p.cuts"), F.col("r.size"), F.col("r.h"))).groupBy("r.source").agg(
            F.sum(F.col("r.size") * F.col("r.n")).alias("took"))
        cuts = stored(sized(added.alias("p").join(took.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").select(
            "p.source", "p.source_size", "p.target", "p.whole",
            (F.col("p.target") - F.col("p.whole") * F.col("p.source_size") - F.coalesce("t.took", F.lit(0))).alias("gap"),
            "p.cuts"), n), "cuts")
    return _exchanged(rows, cuts, n, broadcast_rows)


def _exchanged(rows: DataFrame, cuts: DataFrame, n: int, broadcast_rows: int, looked_at: int = 64) -> DataFrame:
    """``cuts`` with ``gone`` and ``last``: a document taken out and one put in, either may be missing, if that
    brings a source nearer to its target.

    What is missing is less than any document left out. Per source the shortest of those, and about ``looked_at``
    documents each with the smallest ``h``, taken mostly, and the largest, left out mostly, are compared in pairs.
    """
    docs = rows.groupBy("source").agg(F.count("*").alias("docs"))
    known = cuts.alias("p").join(docs.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source"))).select(
        "p.source", "p.gap", "p.cuts", "d.docs")
    known = bounded_broadcast(stored(sized(known, n), "known"), n, broadcast_rows)
    seen = rows.alias("r").join(known.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).where(
        "r.size > 0 and p.gap > 0").select(
        "r.source", "p.gap", F.struct("r.size", "r.h").alias("doc"),
        taken_by(F.col("p.cuts"), F.col("r.size"), F.col("r.h")).alias("taken"),
        # The hash runs from -0.5 to 0.5 of its range.
        ((0.5 - F.abs(F.col("r.h") / float(1 << 64))) * F.col("p.docs") < looked_at).alias("near"),
        (F.col("r.n") == 1).alias("single"))
    lists = seen.where("single").groupBy("source").agg(
        F.max("gap").alias("gap"), F.min(F.when(~F.col("taken"), F.col("doc"))).alias("least"),
        F.collect_list(F.when(F.col("near") & ~F.col("taken"), F.col("doc"))).alias("left"),
        F.collect_list(F.when(F.col("near") & F.col("taken"), F.col("doc"))).alias("held"))
    ins = F.array_compact(F.array_append("left", F.col("least")))
    outs = F.array_append("held", F.lit(None))
    pairs = F.flatten(F.transform(ins, lambda i: F.transform(outs, lambda o: F.struct(
        F.abs(F.col("gap") - i["size"] + F.coalesce(o["size"], F.lit(0))).alias("miss"), i.alias("last"), o.alias("gone")))))
    best = lists.withColumn("best", F.array_min(pairs)).where("best.miss < gap").select("source", "best")
    best = bounded_broadcast(stored(sized(best, n), "exchange"), n, broadcast_rows)
    return stored(sized(cuts.alias("p").join(best.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select(
        "p.source", "p.source_size", "p.target", "p.whole", "p.cuts", "b.best.last", "b.best.gone"), n), "plan")


def taken_by(cuts: Column, size: Column, h: Column) -> Column:
    return F.exists(cuts, lambda c: (size <= c["limit"]) & (h <= c["cut"]))


def mix(
    docs: DataFrame, weights, key: str = "doc_id", text: str = "text", source: str = "source",
    carry: list[str] | None = None, max_epochs: float = 3.0, total: float | None = None, seed: int = 42,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """The columns ``carry`` (all by default) of every document with ``size, source_size, target, repeats, taken``.

    ``size`` counts words, none for missing texts. ``repeats`` says how often the document is in the
    mix: the whole repetitions of its source, and one more if the seeded fractional one takes it;
    ``taken = repeats * size``. A source's taken words miss its target by half of the shortest document
    left out at most, mostly by much less. Missing sources are one source. The choice hangs on seed, key and text alone, so that
    reruns agree; rows equal in both are taken alike. Documents without words are repeated with
    their source's whole repetitions. A table without rows gives none. Columns of ``docs`` named
    like the results are replaced.

    The documents are not shuffled: the plan has one row per source and is broadcast if it has at
    most ``broadcast_rows``, counted first; beyond that Spark joins by source.
    """
    results = ("size", "source_size", "target", "repeats", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in results]
    h, size, name = own("h"), own("size"), own("source")
    measured = docs.select(
        *carry, F.col(source).alias(name), words_in(text).alias(size),
        F.xxhash64(F.lit(seed), F.col(key).cast("string"), whole(text)).alias(h))
    plan = mixing_plan(
        measured.select(F.col(name).alias("source"), F.col(h).alias("h"), F.col(size).alias("size")),
        weights, max_epochs, total, broadcast_rows=broadcast_rows)
    plan = plan.select(F.col("source").alias(own("plan")), *[F.col(c).alias(f"__plan_{c}") for c in ("source_size", "target", "whole", "cuts", "last", "gone")])
    plan = bounded_broadcast(plan, plan.count(), broadcast_rows)
    joined = measured.join(plan, F.col(name).eqNullSafe(plan[plan.columns[0]]))
    def is_it(doc: str) -> Column:
        return F.coalesce((F.col(f"{doc}.size") == F.col(size)) & (F.col(f"{doc}.h") == F.col(h)), F.lit(False))

    fraction = taken_by(F.col("__plan_cuts"), F.col(size), F.col(h)) & ~is_it("__plan_gone") | is_it("__plan_last")
    extra = ((F.col(size) > 0) & fraction).cast("long")
    return joined.select(
        *carry, F.col(size).alias("size"), F.col("__plan_source_size").alias("source_size"),
        F.col("__plan_target").alias("target"), (F.col("__plan_whole") + extra).alias("repeats"),
        ((F.col("__plan_whole") + extra) * F.col(size)).alias("taken"))
