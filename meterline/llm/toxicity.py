"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts."""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.shared import in_batches, own
from meterline.session import stored

# Lower-case letters that look like Latin ones, by script, and digits and signs that stand for letters.
CYRILLIC = dict(zip("аеорсухіѕјԁԛһкмтвнԝьпгґ", "aeopcyxisjdqhkmtbhwbnrr", strict=True))
GREEK = dict(zip("αβεηικμνοπρστυχωςϲϳ", "abenikuvonpstuxwscj", strict=True))
ARMENIAN = dict(zip("օսհոցզյա", "ouhngqjw", strict=True))
LATIN = dict(zip("ıłøđħŧðɑɡɩʟɴʀɪʏʙɢʜᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜰꜱ", "ilodhtdagilnriybghacdejkmoptuvwzfs", strict=True))
DIGITS = dict(zip("013457", "oieast", strict=True))
SIGNS = dict(zip("@$!", "asi", strict=True))
#: White letters on black circles and squares have no decomposition of their own.
_ENCLOSED = {chr(first + i): letter for first in (0x1F150, 0x1F170) for i, letter in enumerate(string.ascii_lowercase)}
_LOOKALIKES = str.maketrans(CYRILLIC | GREEK | ARMENIAN | LATIN | _ENCLOSED)
_LEET = str.maketrans(DIGITS | SIGNS)
#: Substitutes before a letter; behind one, if no other digit follows. A ! there ends a sentence.
_SUBSTITUTES = re.compile(r"[013457@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]+(?!\d)")
_BLANKED = str.maketrans(dict.fromkeys(string.punctuation + "¡¿«»“”„‘’‚…–—·•", " "))
#: Accents, variation selectors and signs without width.
_MARKS = regex.compile(r"[\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE00-\uFE0F\uFE20-\uFE2F\p{Cf}]+")


def _letters(text: str) -> str:
    """Lower case; wide, mathematical and accented letters as plain ones, homoglyphs as Latin letters, no signs without width."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).lower()).translate(_LOOKALIKES)


def fold(text: str) -> str:
    """Plain lower-case letters, digits and signs beside a letter as letters, words between single blanks."""
    low = _SUBSTITUTES.sub(lambda m: m[0].translate(_LEET), _letters(text))
    return " " + " ".join(low.translate(_BLANKED).split()) + " "


@dataclass
class Lexicon:
    """Word beginnings with weights, phrases that are exceptions, and the two numbers that turn a rate into a score."""

    weights: dict[str, float]
    exceptions: dict[str, None] = field(default_factory=dict)
    base: float = -3.0
    slopes: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for start, weight in self.weights.items():
            found.add_word(" " + start, (len(start) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """Where each matched word begins and its weight: the largest of a word, none inside an exception."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if not len(automaton):
        return []
    for end, (size, weight) in automaton.iter(folded):
        at = end - size + 1
        if weight is None:
            spared.append((at, end))
        else:
            best[at] = max(weight, best.get(at, -math.inf))
    found, spared, i, reach = [], sorted(spared), 0, -1
    for at, weight in sorted(best.items()):
        while i < len(spared) and spared[i][0] <= at:
            reach = max(reach, spared[i][1])
            i += 1
        if at >= reach:
            found.append((at, weight))
    return found


def measures(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Weight per hundred words, weight as a logarithm, and the largest weight of a text."""
    folded = fold(text or "")
    found = [w for _, w in hits(folded, automaton)]
    words, total = max(1, folded.count(" ") - 1), sum(found)
    return math.log1p(100 * total / (words + 20)), math.log1p(total), max(found, default=0.0)


def beginnings(word: str, shortest: int, longest: int) -> list[str]:
    """The first letters of a word, and the whole word with a blank behind it."""
    return [word[:n] for n in range(shortest, min(longest, len(word)) + 1)] + [word + " "]


def _counted(sample: DataFrame, only: set[str] | None, shortest: int, longest: int) -> DataFrame:
    """``pattern, toxic, n``: documents of the sample that hold a pattern, summed per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                words = set(fold(text.as_py() or "").split())
                found = {b for w in words for b in beginnings(w, shortest, longest)}
                seen[toxic.as_py()].update(found if only is None else found & only)
        for toxic, counts in seen.items():
            items = list(counts.items())
            for at in range(0, len(items), 50_000):
                part = items[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()),
                     pa.array([n for _, n in part], pa.int64())], names=["pattern", "toxic", "n"])

    return in_batches(sample.select("text", "toxic"), run, "pattern string, toxic int, n bigint").groupBy(
        "pattern", "toxic").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most: int = 20_000, least: int = 8, weight_from: float = 2.5, patterns: int = 5_000,
    shortest: int = 3, longest: int = 8, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """The lexicon and score that fit a bounded sample of labelled rows.

    ``labels`` has key and label, given already without the held-out ones. At most ``most`` labels, those with the
    smallest hash of their key, choose the sample; its distinct texts are written to the shared folder, so that copies of
    one text count once. A pattern is the beginning of
    a folded word, or a whole word. Its weight is the logarithm of how much more often
    toxic documents hold it; patterns of ``least`` toxic documents and a weight of ``weight_from`` stay, the ``patterns``
    best of them at most. A pattern gives way to a longer one that four fifths of its toxic documents hold, and
    of two that begin alike the longer one stays beside the shorter only if it weighs more by 0.5. A pair of
    neighbouring words that holds a match but stands in three clean documents and in no toxic one becomes an
    exception phrase, beside those given. Base and slopes are a logistic regression on the
    sample. Keys that repeat among the labels are one, toxic if any says so; missing keys and labels are left out.
    Without labels of both kinds the lexicon is empty and all scores are alike.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("toxic")).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(most)
    sample = stored(
        docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
            F.broadcast(chosen), "key").groupBy(F.sha2("text", 256).alias("hash")).agg(
            F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    totals = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon({}, dict.fromkeys(fold(e).strip() for e in exceptions))
    if not toxic or not clean:
        lexicon.base = 3.0 if toxic else -3.0
        return lexicon

    frequent = {
        r["pattern"]: r["n"] for r in
        _counted(sample.where("toxic = 1"), None, shortest, longest).where(F.col("n") >= least).toLocalIterator()}
    against = dict(
        (r["pattern"], r["n"]) for r in
        _counted(sample.where("toxic = 0"), set(frequent), shortest, longest).toLocalIterator())
    weight = {p: math.log((n + 0.5) / (toxic + 1)) - math.log((against.get(p, 0) + 0.5) / (clean + 1))
              for p, n in frequent.items()}
    successors = _successors(frequent)
    best = sorted({_specific(p, successors) for p, w in weight.items() if w >= weight_from},
                  key=lambda p: (-weight[p] * math.log(frequent[p]), p))[:patterns]
    for p in sorted(best, key=lambda p: (len(p), p)):
        shorter = max((weight[p[:n]] for n in range(shortest, len(p)) if p[:n] in lexicon.weights), default=-math.inf)
        if weight[p] > shorter + 0.5:
            lexicon.weights[p] = weight[p]

    lexicon.exceptions |= dict.fromkeys(_spared(sample, lexicon))
    rows = _measured(sample, lexicon)
    x = np.array([[r["rate"], r["total"], r["top"]] for r in rows])
    lexicon.base, lexicon.slopes = _logistic(x, np.array([r["toxic"] for r in rows], float))
    return lexicon


def _successors(frequent: dict[str, int], share: float = 0.8) -> dict[str, str]:
    """Per beginning the one longer by a letter that most of its documents hold, ``share`` of them at least."""
    found: dict[str, tuple[int, str]] = {}
    for longer, n in frequent.items():
        shorter = longer[:-1]
        if longer[-1] != " " and n >= share * frequent.get(shorter, math.inf):
            found[shorter] = max(found.get(shorter, (0, "")), (n, longer))
    return {shorter: longer for shorter, (_, longer) in found.items()}


def _specific(pattern: str, successors: dict[str, str]) -> str:
    while pattern in successors:
        pattern = successors[pattern]
    return pattern


def _spared(sample: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            pairs, labels = [], []
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                folded, found = fold(text.as_py() or ""), set()
                for at, _ in hits(folded, automaton):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    found |= {folded[before + 1:end]} if before >= 0 else set()
                    found |= {folded[at + 1:after]} if after >= 0 else set()
                pairs += sorted(found)
                labels += [toxic.as_py()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(labels, pa.int32())], names=["pair", "toxic"])

    counted = in_batches(sample.select("text", "toxic"), run, "pair string, toxic int").groupBy("pair").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    return [r["pair"] for r in counted.where((F.col("toxic") == 0) & (F.col("n") >= least)).toLocalIterator()]


def _measured(sample: DataFrame, lexicon: Lexicon) -> list:
    """Four numbers for each row of the bounded sample."""
    return scored(sample, lexicon, "text", measures_too=True).select("toxic", "rate", "total", "top").collect()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, tuple[float, ...]]:
    """Newton's steps on the ridge-penalised likelihood."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(
            (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), tuple(map(float, w[1:]))


def scored(
    docs: DataFrame, lexicon: Lexicon, text: str = "text", carry: list[str] | None = None, measures_too: bool = False,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are folded and matched; a missing text is empty. Rows are independent: nothing is shuffled,
    repeated rows score alike, no rows give none. Columns of ``docs`` named like the results are replaced.
    """
    names = ["score", "predicted", *(["rate", "total", "top"] if measures_too else [])]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    source = own("text")
    rows = docs.select(*carry, F.col(text).alias(source))
    kinds = [T.DoubleType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.select(*carry).schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, slopes = lexicon.automaton(), np.array(lexicon.slopes)
        for batch in batches:
            x = np.array([measures(t.as_py(), automaton) for t in batch.column(len(carry))]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(lexicon.base + x @ slopes, -30, 30)))
            out = [pa.array(score), pa.array((score >= 0.5).astype("i4")), *map(pa.array, x.T.copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carry)], *out[:len(names)]], names=[*carry, *names])

    return in_batches(rows, run, schema)
