"""One boosted tree on binned rows, grown level by level from histograms of slopes and counts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Nodes by number, the root first; ``feature`` is -1 at a leaf, the right child follows the left one."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def _worth(slope: np.ndarray, count: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """What a node with these sums takes off the loss: squared slope beyond ``l1``, by count and ``l2``."""
    if l1:
        slope = np.maximum(np.abs(slope) - l1, 0)
    worth = slope * slope
    worth /= count + l2
    return worth


#: Sums of a block of features that are looked at together, few enough to stay in the processor's cache.
_BLOCK = 1 << 14


class Cuts(NamedTuple):
    """The best cut of every node: feature, bin, gain, and slope and count below it; the gain is -1 where there is none."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    slope: np.ndarray
    count: np.ndarray


def best_cuts(codes: np.ndarray, node: np.ndarray, slope: np.ndarray, sums: np.ndarray, counts: np.ndarray, bins: int,
              least_rows: int, l1: float, l2: float) -> Cuts:
    """From histograms of counts and slopes, feature by node by bin."""
    nodes, base = len(sums), node * bins
    size, every = nodes * bins, np.arange(nodes)
    found = Cuts(np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -1.0), np.zeros(nodes), np.zeros(nodes))
    each = max(1, _BLOCK // size)
    for first in range(0, len(codes), each):
        some = codes[first:first + each]
        below, slopes = np.empty((len(some), size)), np.empty((len(some), size))
        for f, code in enumerate(some):
            at = base + code
            below[f] = np.bincount(at, minlength=size)
            slopes[f] = np.bincount(at, slope, size)
        shape = len(some), nodes, bins
        below, slopes = below.reshape(shape).cumsum(2), slopes.reshape(shape).cumsum(2)
        above = counts[:, None] - below
        gain = _worth(slopes, below, l1, l2 + 1e-12)
        gain += _worth(sums[:, None] - slopes, above, l1, l2 + 1e-12)
        gain[(below < least_rows) | (above < least_rows)] = -1
        # The best cut of each feature, then the best feature of each node.
        where = gain.argmax(2)
        top = np.take_along_axis(gain, where[:, :, None], 2)[:, :, 0]
        which = top.argmax(0)
        where, top = where[which, every], top[which, every]
        better = top > found.gain
        found.feature[better], found.bin[better], found.gain[better] = first + which[better], where[better], top[better]
        found.slope[better] = slopes[which, every, where][better]
        found.count[better] = below[which, every, where][better]
    return found


def grow(codes: np.ndarray, slope: np.ndarray, columns: np.ndarray, bins: int, depth: int, rate: float,
         least_rows: int, least_gain: float, l1: float, l2: float) -> Tree:
    """A tree on ``codes`` (a row per feature, a byte per row of the series) that lowers half the squared error, whose slopes are given.

    Only the feature numbers ``columns`` may split. Of equal gains the first feature and the lowest cut count.
    """
    mine = codes[columns]
    feature, cut, left, value, gains = [-1], [0], [0], [0.0], [0.0]
    ids = np.zeros(1, np.int64)  # numbers of the nodes of this level
    node = np.zeros(len(slope), np.int64)
    sums, counts = np.array([slope.sum()]), np.array([float(len(slope))])
    for level in range(depth + 1):
        for i, s, c in zip(ids.tolist(), sums.tolist(), counts.tolist(), strict=True):
            value[i] = -rate * np.sign(s) * max(abs(s) - l1, 0) / (c + l2) if c else 0.0
        if level == depth or not len(node):
            break
        best = best_cuts(mine, node, slope, sums, counts, bins, least_rows, l1, l2)
        won = best.gain - _worth(sums, counts, l1, l2 + 1e-12)
        split = np.flatnonzero((best.gain >= 0) & (won > max(least_gain, 1e-9)))
        if not len(split):
            break
        which, where = best.feature[split], best.bin[split]
        first = len(feature)
        for k, (i, f, c) in enumerate(zip(ids[split].tolist(), columns[which].tolist(), where.tolist(), strict=True)):
            feature[i], cut[i], left[i], gains[i] = f, c, first + 2 * k, float(won[split[k]])
        fresh = 2 * len(split)
        feature += [-1] * fresh
        cut += [0] * fresh
        left += [0] * fresh
        value += [0.0] * fresh
        gains += [0.0] * fresh
        # Rows of split nodes go to a child, the others have come to rest.
        number = np.full(len(ids), -1)
        number[split] = np.arange(len(split))
        stays = number[node] >= 0
        k = number[node[stays]]
        mine, slope = mine[:, stays], slope[stays]
        node = 2 * k + (mine[which[k], np.arange(len(k))] > where[k])
        ids = first + np.arange(fresh)
        low, n_low = best.slope[split], best.count[split]
        sums = np.stack([low, sums[split] - low], 1).ravel()
        counts = np.stack([n_low, counts[split] - n_low], 1).ravel().astype(float)
    return Tree(*(np.array(a) for a in (feature, cut, left, value, gains)))


def leaves(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The value each row comes to."""
    node = np.zeros(codes.shape[1], np.int64)
    rows = np.arange(codes.shape[1])
    while True:
        inner = tree.feature[node] >= 0
        if not inner.any():
            return tree.value[node]
        right = codes[np.maximum(tree.feature[node], 0), rows] > tree.cut[node]
        node = np.where(inner, tree.left[node] + right, node)
