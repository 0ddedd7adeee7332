"""Secrets in texts, told apart by how many owners and repositories share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import numbered, own, whole
from meterline.session import stored

# The patterns of the candidates, the group that holds the value, and its least length.
KINDS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Shorter runs would be dropped; a run can't be left by a shorter match inside it.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Formats of issued keys that the three kinds may miss.
ISSUED = r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
#: What sets a credential in use apart from words: length, a digit and a letter.
LIVE_LOOKING = r"^(?=.{16,})(?=.*[0-9])(?=.*[A-Za-z])"


#: Lengths summed at once on the way to the places of matches.
_STRETCH = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _runs(lengths: Column) -> Column:
    """Array of the sums of all lengths before each stretch of ``_STRETCH``."""
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / _STRETCH).cast("int")),
        lambda b: _total(F.slice(lengths, b * _STRETCH + 1, _STRETCH)))
    return let(stretches, lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, 1, b))))


def matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """``kind, start, end, from, value`` of all leftmost non-overlapping matches whose group is long enough.

    Code points from 0, end exclusive; ``from`` is where the value begins. The text is split
    at the matches, and the lengths of the parts give their places, added up by stretches, so
    that a text of very many matches costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.struct(found.alias("found"), values.alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["found"], lambda m, i: (F.length(m) + F.length(F.get(p["gaps"], i))).cast("long"))
        measured = let(steps, lambda s: F.struct(s.alias("steps"), _runs(s).alias("runs")))
        return let(measured, lambda s: F.transform(
            p["found"], lambda m, i: span(
                F.get(s["runs"], F.floor(i / _STRETCH).cast("int"))
                + _total(F.slice(s["steps"], F.floor(i / _STRETCH).cast("int") * _STRETCH + 1, i % _STRETCH))
                + F.length(F.get(p["gaps"], i)), F.length(m), F.get(p["values"], i))))

    def span(start: Column, size: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + size).cast("long").alias("end"),
            (start + size - F.length(value)).cast("long").alias("from"), value.alias("value"))

    spans = F.filter(let(parts, placed), lambda s: F.length(s["value"]) >= least)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,from:bigint,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate([*KINDS, "live"])}
    of = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(of, s["kind"]).alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind")))), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def find_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id",
    carry: list[str] | None = None, example_owners: int = 3, example_repositories: int = 10, digest_seed: str = "",
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``base`` and ``spans`` (arrays of kind, start, end) and ``n_live, n_example``.

    ``base`` lists the matches of ``KINDS``. Their values, and the keys of ``ISSUED`` formats, are candidates: each is hashed,
    and over the whole corpus the distinct owners and repositories of a hash are counted. A value that
    ``example_owners`` or more owners share, or that stands in ``example_repositories`` or more repositories of however few owners,
    is an example copied around. A live-looking one with fewer of both gives a further span of kind ``live`` over the value itself. ``spans`` holds both.

    Texts stay where they are: only hashes with owner and repository are shuffled, summed before by
    map-side combine, and joined back to the candidates, which Spark may split where a value is frequent.
    Missing texts are empty, a missing owner is an owner of its own, a missing repository too. Repeated rows each have their own
    result and count once as owner and repository. A table without rows gives none. Columns
    of ``docs`` named like the results are replaced.
    """
    results = ("base", "spans", "n_live", "n_example")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in results]
    number, spans, who, where, body = own("row"), own("spans"), own("owner"), own("repository"), own("text")
    rows = docs.select(
        *carry, F.col(owner).cast("string").alias(who), F.col(repository).cast("string").alias(where),
        whole(text).alias(body))
    parts = [matches(F.col(body), *spec, kind) for kind, spec in KINDS.items()]
    parts.append(matches(F.col(body), ISSUED, 0, 1, "issued"))
    hashed = F.transform(F.concat(*parts), lambda s: F.struct(
        s["kind"], s["start"], s["end"], s["from"], F.sha2(F.concat(F.lit(digest_seed), s["value"]), 256).alias("hash"),
        s["value"].rlike(LIVE_LOOKING).alias("looks_live")))
    rows = numbered(rows.select(*carry, who, where, hashed.alias(spans)), number, "candidates")

    # An owner that is missing must count too, hence the marks before the names.
    named = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")).alias(n) for c, n in ((who, "owner"), (where, "repository"))]
    each = rows.where(F.size(spans) > 0).select(number, *named, F.inline(spans))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = each.groupBy("hash", "repository").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.count("*").alias("repositories"))
    shared = stored(owners.join(repositories, "hash"), "ownership")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    judged = stored(each.join(shared, "hash").select(
        number, "from", "end", example.alias("example"), (~example & F.col("looks_live")).alias("live")), "judged")
    added = judged.groupBy(number).agg(
        F.collect_set(F.when(F.col("live"), F.struct(
            F.lit("live").alias("kind"), F.col("from").alias("start"), "end"))).alias("added"),
        F.count(F.when(F.col("example"), 1)).alias("n_example"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    base = F.transform(F.filter(spans, lambda s: s["kind"] != "issued"), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    full = rows.join(added, number, "left").select(
        *carry, _ordered(base).alias("base"), F.coalesce("added", empty).alias("__added"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
    return full.select(
        *carry, "base", _ordered(F.concat("base", "__added")).alias("spans"),
        F.size("__added").cast("long").alias("n_live"), "n_example")
