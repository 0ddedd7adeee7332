"""Language of texts by a convolutional network over their bytes, trained in numpy on labelled texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.shared import in_batches, own

#: Bytes of a window; successive ones share the reach of the widest filter, so that each run of bytes is seen once.
WINDOW = 256
#: Bytes a filter sees, widest first, and filters of each width.
WIDTHS = (4, 3, 2)
FILTERS = 16
REACH = max(WIDTHS) - 1
SPAN = WINDOW - REACH
#: Windows in one pass, few enough for their products to stay in the processor's cache.
_AT_ONCE = 32

UNKNOWN = "und"
_ANY_LETTER = re.compile(r"[^\W\d_]")
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], np.float32)


def windows_of(text: str) -> np.ndarray:
    """The whole text, in lower case, as a view of windows; the last one ends in zeros."""
    data = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // SPAN))
    padded = np.zeros(n * SPAN + REACH, "u1")
    padded[:len(data)] = np.frombuffer(data, "u1")
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::SPAN]


@dataclass(frozen=True)
class Network:
    """Filters as one table per place in them: a row per byte, a column per filter that reaches the place."""

    languages: tuple[str, ...]
    taps: tuple[np.ndarray, ...]
    lift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest response of each filter in each window, not below zero, and where it is."""
        seen = np.take(self.taps[0], windows[:, :SPAN], axis=0)
        for at, tap in enumerate(self.taps[1:], 1):
            seen[:, :, :tap.shape[1]] += np.take(tap, windows[:, at:at + SPAN], axis=0)
        where = seen.argmax(1)
        top = np.take_along_axis(seen, where[:, None], 1)[:, 0] + self.lift
        return np.maximum(top, 0), where

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        raw = pooled @ self.weights + self.bias
        raw = np.exp(raw - raw.max(1, keepdims=True))
        return raw / raw.sum(1, keepdims=True)

    def judge(self, texts: Sequence[str]) -> np.ndarray:
        """A row of probabilities per text: the mean over all its windows, by the letters they hold."""
        total = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            windows = np.concatenate(rows)
            letters = _LETTER[windows[:, :SPAN]].sum(1)
            np.add.at(total, owners, self.softmax(self.responses(windows)[0]) * letters[:, None])
            np.add.at(weight, owners, letters)
            rows.clear()
            owners.clear()

        for i, text in enumerate(texts):
            windows = windows_of(text)
            for at in range(0, len(windows), _AT_ONCE):
                rows.append(windows[at:at + _AT_ONCE])
                owners.extend([i] * len(rows[-1]))
                if len(owners) >= _AT_ONCE:
                    flush()
        if owners:
            flush()
        return total / np.maximum(weight, 1)[:, None]


def train(
    windows: np.ndarray, labels: np.ndarray, languages: Sequence[str], epochs: int = 6, rate: float = 0.01,
    batch: int = 64, seed: int = 42,
) -> Network:
    """Fit filters and softmax by Adam on the cross-entropy. A third of the windows is cut short in each epoch, so that
    short texts are known as well; languages with few windows weigh as much as the others."""
    rng = np.random.default_rng(seed)
    columns = [FILTERS * sum(w > at for w in WIDTHS) for at in range(max(WIDTHS))]
    n_filters = columns[0]
    taps = [rng.normal(0, 0.1, (256, c)).astype(np.float32) for c in columns]
    for tap in taps:
        tap[0] = 0
    lift = np.zeros(n_filters, np.float32)
    weights = rng.normal(0, 0.1, (n_filters, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    values = [*taps, lift, weights, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    net = Network(tuple(languages), tuple(taps), lift, weights, bias)
    share = len(labels) / len(languages) / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    step, steps = 0, epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            seen = windows[chosen].copy()
            cut = np.where(rng.random(len(chosen)) < 1 / 3, rng.integers(8, WINDOW, len(chosen)), WINDOW)
            seen[np.arange(WINDOW)[None] >= cut[:, None]] = 0
            pooled, where = net.responses(seen)
            slope = net.softmax(pooled)
            slope[np.arange(len(chosen)), labels[chosen]] -= 1
            slope *= (share[labels[chosen]] / len(chosen))[:, None]
            back = (slope @ weights.T) * (pooled > 0)
            slopes = []
            for place, tap in enumerate(taps):
                c = tap.shape[1]
                byte = np.take_along_axis(seen, where[:, :c] + place, 1).astype(np.int64)
                slopes.append(np.bincount(
                    (byte * c + np.arange(c)).ravel(), back[:, :c].ravel(), 256 * c).reshape(256, c))
                slopes[-1][0] = 0
            slopes += [back.sum(0), pooled.T @ slope, slope.sum(0)]
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for value, slope_, m, v in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (slope_ - m)
                v += 0.001 * (slope_ * slope_ - v)
                value -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def learn(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 3_000, each: int = 4,
    most_languages: int = 200, epochs: int = 6, seed: int = 42,
) -> Network | None:
    """A network fitted on about ``most`` rows, equally many of each language where it has them, ``each`` windows
    of a text spread over its whole length. The rows are those with the smallest hashes of their keys, so that reruns agree.

    Rows without text, language or letters are passed over; without any other row there is no network. Of more than
    ``most_languages`` languages the frequent ones are learnt.
    """
    rows = labelled.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    kinds = counts.collect()
    if not kinds:
        return None
    wanted = most / len(kinds)
    # At most ``most_languages`` rows.
    shares = F.broadcast(rows.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, wanted / r["count"])) for r in kinds], "lang string, share double"))
    picked = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)
    sample = rows.join(shares, "lang").where(picked).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _ANY_LETTER.search(value):
                    windows = windows_of(value)
                    places = np.unique(np.linspace(0, len(windows) - 1, each).astype(int))
                    langs.append(name)
                    found.append(windows[places].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "windows"])

    got = sorted((r["lang"], bytes(r["windows"])) for r in in_batches(sample, cut, "lang string, windows binary").collect())
    if not got:
        return None
    languages = sorted({name for name, _ in got})
    blocks = [np.frombuffer(w, "u1").reshape(-1, WINDOW) for _, w in got]
    labels = np.repeat([languages.index(name) for name, _ in got], [len(b) for b in blocks])
    return train(np.concatenate(blocks), labels, languages, epochs, seed=seed)


def identify(
    docs: DataFrame, network: Network | None, text: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``lang_pred, score``, of every whole text.

    ``score`` is the probability of ``lang_pred``, averaged over all windows of the text by their letters. A text that is missing
    or has no letter, and every text without a network, is ``und`` with score 0. Equal texts get equal results; a table without
    rows gives none; columns named like the results are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    schema = T.StructType([
        *docs.select(*carry).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(len(carry))]
            known = [i for i, t in enumerate(texts) if network and t and _ANY_LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                judged = network.judge([texts[i] for i in known])
                for i, best, score in zip(known, judged.argmax(1).tolist(), judged.max(1).tolist(), strict=True):
                    names[i], scores[i] = network.languages[best], min(1.0, score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*carry, "lang_pred", "score"])

    return in_batches(docs.select(*carry, F.col(text).alias(own("text"))), run, schema)
