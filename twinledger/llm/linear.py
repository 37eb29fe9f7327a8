"""Sparse logistic regression on a bounded labelled sample, and hashed features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Feature indices of all rows one after another; row i ends before ``ends[i]``."""

    columns: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists) -> Rows:
        sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
        flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if len(lists) else np.empty(0, np.int32)
        return cls(flat, np.cumsum(sizes))

    def totals(self, weights: np.ndarray) -> np.ndarray:
        out = [np.empty(0)]
        for ends, columns in self.blocks():
            running = np.concatenate([[0.0], np.cumsum(weights[columns])])
            out.append(np.diff(running[ends], prepend=0.0))
        return np.concatenate(out)

    def within(self, active: np.ndarray) -> Rows:
        """The rows with only the active columns, numbered anew in order."""
        kept = np.concatenate([[0], np.cumsum(active[self.columns])])
        place = np.cumsum(active) - 1
        return Rows(place[self.columns[active[self.columns]]].astype(np.int32), kept[self.ends])

    def apart(self, numbers: np.ndarray, others: Rows) -> tuple[Rows, Rows]:
        """What the numbered rows hold more than the others beside them, and what less."""
        more, less, starts = [], [], np.concatenate([[0], self.ends])
        other = np.concatenate([[0], others.ends])
        for i, number in enumerate(numbers):
            mine = self.columns[starts[number] : starts[number + 1]]
            theirs = others.columns[other[i] : other[i + 1]]
            values, place = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
            n = np.bincount(place[: len(mine)], minlength=len(values)) - np.bincount(place[len(mine) :], minlength=len(values))
            more.append(np.repeat(values, np.maximum(n, 0)))
            less.append(np.repeat(values, np.maximum(-n, 0)))
        return Rows.of(more), Rows.of(less)

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        total, at = np.zeros(size), 0
        for ends, columns in self.blocks():
            each = np.repeat(values[at : at + len(ends)], np.diff(ends, prepend=0))
            total += np.bincount(columns, weights=each, minlength=size)
            at += len(ends)
        return total

    def blocks(self, rows: int = 1000):
        """Ends and columns of so many rows at a time, which bounds what a step holds in memory."""
        start = 0
        for at in range(0, len(self.ends), rows):
            ends = self.ends[at : at + rows]
            yield ends - start, self.columns[start : ends[-1]]
            start = ends[-1]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def evidence(lists: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """By how many deviations each feature's share of positive rows is off the mean.

    Half a row is added to the variance, so that a feature of few rows counts for little but not for
    nothing, however few rows there are.
    """
    distinct = [np.unique(x) for x in lists]
    met = np.bincount(np.concatenate([np.empty(0, np.int32), *distinct]).astype(np.int64), minlength=size)
    good = [x for x, y in zip(distinct, labels) if y > 0.5]
    positive = np.bincount(np.concatenate([np.empty(0, np.int32), *good]).astype(np.int64), minlength=size)
    n, share = max(2, len(labels)), float(np.mean(labels > 0.5)) if len(labels) else 0.0
    return np.abs(positive - met * share) / np.sqrt(met * share * (1 - share) * (n - met) / (n - 1) + 0.5)


def fit(
    rows: Rows, labels: np.ndarray, size: int, l1: float = 1e-5, l2: float = 1e-4, steps: int = 150,
    rate: float = 0.1, weights: np.ndarray | None = None,
    twins: tuple[np.ndarray, Rows] | None = None, twin_penalty: float = 0.0,
    active: np.ndarray | None = None, scale: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by proximal Adam steps over all rows.

    ``labels`` may be probabilities. ``twins`` are (row numbers, changed rows): the squared difference
    between a row's logit and its twin's counts ``twin_penalty`` times. Features outside ``active``
    (by default those met fewer than twice) keep the weight 0. ``scale`` multiplies a feature's values, so
    that a feature of a small one moves slower and pays more of ``l2`` for the same weight.
    """
    if not len(labels):
        return np.zeros(size), 0.0
    share = (np.ones(len(labels)) if weights is None else weights).astype(np.float64)
    share = share / share.sum()
    prior = min(max(float(share @ labels), 1e-3), 1 - 1e-3)
    if active is None:
        active = np.bincount(rows.columns, minlength=size) >= 2
    whole, size, rows = np.zeros(size), int(active.sum()), rows.within(active)
    twins = None if twins is None or not len(twins[0]) else rows.apart(twins[0], twins[1].within(active))
    unit = np.ones(size) if scale is None else scale[active]
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(size)
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = rows.totals(w * unit) + bias
        error = share * (sigmoid(z) - labels)
        gradient = unit * rows.spread(error, size) + l2 * w
        if twins is not None:
            gap = twins[0].totals(w * unit) - twins[1].totals(w * unit)
            pull = twins[0].spread(gap, size) - twins[1].spread(gap, size)
            gradient += 2 * twin_penalty / len(gap) * unit * pull
        speed = rate / (1 + step / 50)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        pace = speed / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        w = w - pace * first / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace * l1, speed), 0)
        slope = float(error.sum())
        fb, sb = 0.9 * fb + 0.1 * slope, 0.99 * sb + 0.01 * slope**2
        bias -= speed * (fb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-6)
    whole[active] = w * unit
    return whole, bias
