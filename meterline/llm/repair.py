"""Cheapest repairs of conversations: shortest paths over a lattice of rows and roles, found by an auction of node prices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import in_batches, whole
from meterline.session import stored

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
INITIALS = "sua"
REROLE = INSERT = LEAVE_TRUNCATED = 3
DELETE = 4
#: What may have been said last: nothing, system, user, assistant. A conversation ends after nothing or the assistant.
STATES = 4
_ENDS = (0, None, None, 0)
#: The state after a row of each initial that is kept, and after the one role that may be put in.
_KEPT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
_PUT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Rows of a conversation that make up one lattice, as a power of two.
PIECE_BITS = 6


class Auction:
    """Prices of the nodes of one lattice: node ``4 * i + s`` stands before row ``i`` with ``s`` said last.

    A price never exceeds the cost of any arc plus the price at its end. A path grows along arcs where both are
    equal and shrinks where none is, its last node's price then rising to the least of them; so it reaches the end as a shortest path,
    and the prices on it are the distances left. It grows by the arc whose letter comes first, and as prices only rise, no arc
    with an earlier letter is tight then: the tight arcs followed by letter are the path that is least as a string.
    """

    def __init__(self, codes: Sequence[int], ends: Sequence[int | None], last: bool):
        self.codes, self.ends, self.last = codes, ends, last
        self.end = STATES * (len(codes) + 1)
        known = [e for e in ends if e is not None]
        least = min(known, default=0)
        self.most = 8 * len(codes) + 16 + max(known, default=0)
        # A row costs at least what its fault does, whatever is said around it.
        forced = []
        for code in reversed(codes):
            fault, initial = divmod(code, 4)
            forced.append(DELETE if fault in (BLANK, DUPLICATE) else LEAVE_TRUNCATED if fault == TRUNCATED
                          else REROLE if initial == len(INITIALS) else 0)
        below = [least]
        for cost in forced:
            below.append(below[-1] + cost)
        self.price = [p for p in reversed(below) for _ in range(STATES)] + [0]
        self._arcs: list[list[tuple[str, int, int]] | None] = [None] * self.end

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """Letter, cost and end of every arc, by letter."""
        found = self._arcs[node]
        if found is None:
            i, s = divmod(node, STATES)
            found = self._arcs[node] = []
            if i == len(self.codes):
                if self.ends[s] is not None:
                    found.append(("", self.ends[s], self.end))
                if self.last:
                    found.append(("I", INSERT, STATES * i + _PUT[s]))
                return found
            fault, initial = divmod(self.codes[i], 4)
            after = STATES * (i + 1)
            found += [("D", DELETE, after + s), ("I", INSERT, STATES * i + _PUT[s])]
            if fault not in (BLANK, DUPLICATE):
                extra = LEAVE_TRUNCATED if fault == TRUNCATED else 0
                kept = _KEPT[s][initial] if initial < len(INITIALS) else None
                if kept is not None:
                    found.append(("K", extra, after + kept))
                found.append(("R", REROLE + extra, after + _PUT[s]))
        return found

    def reach(self, start: int) -> int | None:
        """The distance from a state before the first row to the end; None if there is no way."""
        price, path = self.price, [start]
        while path[-1] != self.end:
            node = path[-1]
            best, to = self.most + 1, None
            for _, cost, after in self.arcs(node):
                if cost + price[after] < best:
                    best, to = cost + price[after], after
            if price[node] < best:
                price[node] = best
                if node != start:
                    path.pop()
                elif best > self.most:
                    return None
            elif to is None:  # given up before
                return None
            else:
                path.append(to)
        return price[start]

    def traced(self, start: int) -> tuple[int, list[str]]:
        """The state at the end and the edits row by row, each a letter and the initial of the role put in; ``reach`` comes first."""
        edits, node, said = [""] * max(1, len(self.codes)), start, start
        while node != self.end:
            letter, _, after = next(a for a in self.arcs(node) if self.price[node] == a[1] + self.price[a[2]])
            if letter:
                put = ROLES[after % STATES][0] if letter in "IR" else "-"
                edits[min(node // STATES, len(self.codes) - 1)] += letter + put
                said = after % STATES
            node = after
        return said, edits


@lru_cache(1 << 14)
def _crossings(codes: tuple[int, ...], last: bool) -> list[int | None]:
    """The costs of a piece from every state before it to every state after it."""
    found: list[list[int | None]] = []
    for state in range(STATES):
        auction = Auction(codes, [0 if s == state else None for s in range(STATES)], last)
        found.append([auction.reach(s) for s in range(STATES)])
    return [found[after][before] for before in range(STATES) for after in range(STATES)]


@lru_cache(1 << 14)
def _solved(codes: tuple[int, ...], ends: tuple[int | None, ...], last: bool, starts: tuple[int, ...]) -> tuple[list, list]:
    """The state after the piece and the edits of its rows, for each state before it."""
    auction = Auction(codes, ends, last)
    states, edits = [], []
    for start in starts:
        state, found = auction.traced(start) if auction.reach(start) is not None else (start, [])
        states.append(state)
        edits.append(found)
    return states, edits


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_crossings(tuple(codes), last) for codes, last in zip(
            batch.column("codes").to_pylist(), batch.column("last").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("piece"), pa.array(made, pa.list_(pa.int64()))], names=["conv", "piece", "costs"])


def _border_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices behind every piece of a conversation, from its end; an arc of this lattice is a way through a piece."""
    for batch in batches:
        convs, pieces, prices = [], [], []
        for conv, crossed in _rows_of(batch):
            now: list[int | None] = list(_ENDS)
            for one in reversed(crossed):
                convs.append(conv)
                pieces.append(one["piece"])
                prices.append(now)
                ways = [[(c + p) for c, p in zip(one["costs"][STATES * s:STATES * (s + 1)], now, strict=True)
                         if c is not None and p is not None] for s in range(STATES)]
                now = [min(w, default=None) for w in ways]
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, batch.schema.field("conv").type), pa.array(pieces, pa.int64()),
             pa.array(prices, pa.list_(pa.int64()))], names=["conv", "piece", "ends"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states, edits = [], []
        for codes, last, ends in zip(*[batch.column(c).to_pylist() for c in ("codes", "last", "ends")], strict=True):
            starts = (0,) if ends is None else tuple(range(STATES))
            state, found = _solved(tuple(codes), _ENDS if ends is None else tuple(ends), last, starts)
            states.append(state)
            edits.append(found)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv", "piece", "ats", "codes")), pa.array(states, pa.list_(pa.int64())),
             pa.array(edits, pa.list_(pa.list_(pa.string())))], names=["conv", "piece", "ats", "codes", "states", "edits"])


class Repair(NamedTuple):
    """``rows`` in order: ``conv, at, turn, role, text, gone, initial``; ``edits``: ``conv, at, code, edit`` of those that aren't gone."""

    rows: DataFrame
    edits: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by ``crc32(conv_id:turn) % 20``; a missing value is one blank in all but ``turn`` itself.

    0: the row is ``gone``, only its conversation is still named; 1: no text; 2: no ``.!?``; 3: twice; 4: role user.
    """
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(named.cast("binary")) % 20
    text = whole(F.coalesce("text", F.lit(" ")))
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"), F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _codes(rows: DataFrame) -> DataFrame:
    """``conv, at, code`` of the rows that aren't gone: four times the first fault, plus the place of the initial."""
    here = rows.where("not gone")
    # Of equal rows only the first is no duplicate; a join by the row's own number can't be skewed.
    first = here.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = (F.when(F.col("last_char") == "", BLANK).when(F.col("first").isNull(), DUPLICATE)
             .when(~F.col("last_char").isin(".", "!", "?"), TRUNCATED).otherwise(0))
    place = F.lit(0)
    for i, initial in enumerate((*INITIALS, None)):
        place = F.when(F.col("initial") == initial, i).otherwise(place) if initial else F.when(
            F.col("initial").isin(*INITIALS), place).otherwise(i)
    return here.select("conv", "at", "initial", "last_char").join(first, "at", "left").select(
        "conv", "at", (fault * 4 + place).cast("int").alias("code"))


def repair(rows: DataFrame, gone: Column | None = None) -> Repair:
    """The cheapest edits that make the roles of every conversation ``(system? (user assistant)+)?``, told by their initials.

    ``rows`` has ``conv_id, turn, role, text``; ``gone`` marks rows that only name their conversation. Rows go by turn, missing ones
    first, then by role and text; a missing role or text is one blank. A row's first fault counts: blank, duplicate (role and text
    seen earlier in the conversation), truncated (no ``.!?`` at the end). Keep costs 0, Rerole to user or assistant 3, Delete 4,
    Insert of an empty user or assistant row 3; blank and duplicate rows must go, a truncated one that stays costs 3 more.
    Of the cheapest sequences of edits the least string counts. Equal rows need no order; a missing ``conv_id`` is a conversation too;
    roles that begin with none of s, u, a can't be kept; other columns are left out. An empty table gives no rows.

    The rows are sorted over all partitions, so that a conversation of any length is dealt over many. Its lattice is cut
    into pieces of at most 64 rows, solved apart from each other: first the costs between the states at a piece's borders, then the prices at all
    borders, then the edits for every state a piece may start in. Where a conversation is one piece, only the last is done. What is
    gathered per conversation is 16 costs a piece.
    """
    tie, text = F.monotonically_increasing_id(), F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    made = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(gone if gone is not None else F.col("gone") if "gone" in rows.columns else F.lit(False), F.lit(False)).alias("gone"),
        tie.alias("tie"))
    ordered = stored(
        made.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "gone",
            F.substring("role", 1, 1).alias("initial"),
            F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("last_char"),
            F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)).alias("digest")), "turns")
    steps = F.array_sort(F.collect_list(F.struct("at", "code")))
    pieces = stored(
        _codes(ordered).groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(steps.alias("steps")).select(
            "conv", "piece", F.col("steps.at").alias("ats"), F.col("steps.code").alias("codes")), "pieces")
    lengths = stored(pieces.groupBy("conv").agg(F.max("piece").alias("until"), F.count("*").alias("n")).where("n > 1"), "lengths")
    kind = pieces.schema["conv"].dataType.simpleString()
    same = pieces["conv"].eqNullSafe(lengths["conv"])
    several = pieces.join(lengths, same).select(pieces["conv"], "piece", "ats", "codes", (F.col("piece") == F.col("until")).alias("last"))
    crossed = stored(in_batches(
        several.select("conv", "piece", "codes", "last"), _cross, f"conv {kind}, piece long, costs array<long>"), "crossings")
    gathered = F.array_sort(F.collect_list(F.struct("piece", "costs")))
    prices = in_batches(
        crossed.groupBy("conv").agg(gathered.alias("crossed")), _border_prices, f"conv {kind}, piece long, ends array<long>")
    whole_ones = pieces.join(lengths, same, "left_anti").withColumns({"last": F.lit(True), "ends": F.lit(None).cast("array<long>")})
    cut = several.alias("p").join(
        prices.alias("q"), F.col("p.conv").eqNullSafe(F.col("q.conv")) & (F.col("p.piece") == F.col("q.piece"))).select("p.*", "ends")
    solved = stored(in_batches(
        whole_ones.unionByName(cut).select("conv", "piece", "ats", "codes", "last", "ends"), _solve,
        f"conv {kind}, piece long, ats array<long>, codes array<int>, states array<long>, edits array<array<string>>"), "solved")
    # The state before each piece follows from those before it.
    chained = solved.where(F.size("states") > 1).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("piece", "states"))).alias("chain")).select("conv", F.inline(F.aggregate(
            "chain", F.struct(F.lit(0).cast("long").alias("said"), F.expr("cast(array() as array<struct<piece: long, start: long>>)").alias("done")),
            lambda so_far, one: F.struct(
                F.element_at(one["states"], (so_far["said"] + 1).cast("int")).alias("said"),
                F.concat(so_far["done"], F.array(F.struct(one["piece"].alias("piece"), so_far["said"].alias("start")))).alias("done")),
            lambda result: result["done"])))
    begun = solved.alias("s").join(
        chained.alias("c"), F.col("s.conv").eqNullSafe(F.col("c.conv")) & (F.col("s.piece") == F.col("c.piece")), "left")
    chosen = F.element_at("edits", (F.coalesce("start", F.lit(0)) + 1).cast("int"))
    edits = stored(begun.select("s.conv", F.inline(F.arrays_zip(
        F.col("ats").alias("at"), F.col("codes").alias("code"), chosen.alias("edit")))).toDF("conv", "at", "code", "edit"), "edits")
    return Repair(ordered.select("conv", "at", "turn", "role", "text", "gone", "initial"), edits)


def repaired_rows(repaired: Repair) -> DataFrame:
    """``conv_id, at, place, edit, role, text``: the rows of the repaired conversations, in order of ``at, place``."""
    lines = F.filter(F.regexp_extract_all("edit", F.lit("(..)"), 1), lambda line: ~line.startswith("D"))
    put, letter = F.substring("line", 2, 1), F.substring("line", 1, 1)
    role = F.when(put == "u", "user").when(put == "a", "assistant").otherwise(F.col("role"))
    return repaired.rows.join(repaired.edits.select("at", "edit"), "at").select(
        F.col("conv").alias("conv_id"), "at", "role", "text", F.posexplode(lines).alias("place", "line")).select(
        "conv_id", "at", "place", letter.alias("edit"), role.alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text"))


class _Tally:
    """What the report says of one conversation, row after row."""

    def __init__(self, conv):
        self.conv, self.turns, self.low, self.high, self.turn = conv, 0, None, None, None
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = self.lines = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update(((b"\n" if self.lines else b"") + f"{role}:".encode("utf-8", "surrogatepass")) + text.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def row(self, turn: int | None, role: str, text: str, initial: str, code: int, edit: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        fault = code // 4
        self.faults[fault] += 1
        for letter, put in zip(edit[::2], edit[1::2], strict=True):
            self.audit.append(letter)
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter]
            self.cost += LEAVE_TRUNCATED if letter in "KR" and fault == TRUNCATED else 0
            if letter != "D":
                self.line({"u": "user", "a": "assistant"}.get(put, role), "" if letter == "I" else text)

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def report(repaired: Repair) -> DataFrame:
    """One row per conversation, those whose rows are all gone included: ``conv_id``, ``gaps`` (turns missing between the first and the
    last), ``blank, duplicate, truncated`` (rows by first fault), ``illegal`` (neighbours whose initials aren't su, ua or au),
    ``cost``, ``audit`` (the edits' initials) and ``repaired_sha256`` of the repaired ``role:text`` lines.

    A digest is made from the first line to the last, so the rows of a conversation pass through one task, sorted, one batch at
    a time; that task holds a letter per edit and no texts.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = repaired.rows.schema["conv"].dataType.simpleString()
    both = repaired.rows.unionByName(repaired.edits, allowMissingColumns=True)
    # The edits of a row come right before it.
    ready = both.repartition("conv").sortWithinPartitions("conv", "at", F.col("code").asc_nulls_last()).select(
        "conv", "turn", "role", "text", "gone", "initial", "code", "edit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, edit, found = None, None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * (len(names) + 3)
            conv_type = types["conv"]
            arrays = [pa.array(columns[0], conv_type), *[pa.array(c, pa.int64()) for c in columns[1:-2]],
                      *[pa.array(c, pa.string()) for c in columns[-2:]]]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names, "audit", "repaired_sha256"])

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types["conv"] = batch.schema.field("conv").type
            for conv, turn, role, text, gone, initial, code, letters in _rows_of(batch):
                if tally is None or conv != tally.conv:
                    if tally is not None:
                        found.append(tally.result())
                    tally = _Tally(conv)
                if code is not None:
                    edit = (code, letters)
                elif not gone:
                    tally.row(turn, role, text, initial, *edit)
            if found:
                yield made()
        if tally is not None:
            found.append(tally.result())
            yield made()

    return in_batches(
        ready, run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string")
