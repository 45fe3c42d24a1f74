"""The best ``k`` of each query while blocks of scores pass by.

A block is a matrix of queries by candidates. Once a query holds ``k`` results, only cells that reach the worst of them are
looked at, so most of a block is compared once and neither rounded nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

SCORE_DIGITS = 6
# half a unit of the last digit, on both sides of a comparison
ROUNDING = 10.0**-SCORE_DIGITS


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_DIGITS) + 0.0


def _order(ids: np.ndarray) -> np.ndarray:
    """Places in ascending order, nulls first as in Spark."""
    if ids.dtype.kind in "iu":
        return np.argsort(ids, kind="stable")
    return pd.Series(ids).sort_values(kind="stable", na_position="first").index.to_numpy()


class BestLists:
    """Best ``k`` (score, identifier) of ``n`` queries, ties to the smaller identifier."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        # score of the k-th result, of the queries that have as many
        self.least = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(
        self,
        scores: np.ndarray,
        ids: np.ndarray,
        exact: Callable[[np.ndarray, np.ndarray | None], np.ndarray],
        error: float = 0.0,
        queries: np.ndarray | None = None,
    ) -> None:
        """``scores`` are within ``error`` of the exact ones, and ``-inf`` where a pair does not count. ``exact(rows, columns)``
        gives the exact scores of single cells, without columns those of whole rows. ``queries`` are the numbers of the rows'
        queries, if these are not all."""
        slack = 2.0 * error + ROUNDING
        least = self.least if queries is None else self.least[queries]
        floor = least - slack
        fresh = np.flatnonzero(np.isneginf(least))
        number = np.arange(self.n) if queries is None else queries
        if len(fresh) and scores.shape[1] > self.k:
            block = scores if len(fresh) == len(scores) else scores[fresh]
            floor[fresh] = np.partition(block, -self.k, axis=1)[:, -self.k].astype(np.float64) - slack
        lowest = float(np.finfo(scores.dtype).min)
        reached = scores >= np.maximum(floor, lowest).astype(scores.dtype)[:, None]
        rows, columns = np.divmod(np.flatnonzero(reached), scores.shape[1])
        counts = np.bincount(rows, minlength=len(scores))
        # many cells of one row: copies, whose ties are put in order right here
        heavy = np.flatnonzero(counts > 64 + 4 * self.k)
        if len(heavy):
            light = ~np.isin(rows, heavy)
            rows, columns = rows[light], columns[light]
            by_id = _order(ids)
            for start in range(0, len(heavy), 256):
                some = heavy[start : start + 256]
                values = np.where(np.isneginf(scores[some]), -np.inf, rounded(exact(some, None)))[:, by_id]
                best = np.argsort(-values, axis=1, kind="stable")[:, : self.k]
                self._hold(np.repeat(number[some], best.shape[1]), ids[by_id[best.ravel()]], np.take_along_axis(values, best, axis=1).ravel())
        for start in range(0, len(rows), 65_536):
            r, c = rows[start : start + 65_536], columns[start : start + 65_536]
            self._hold(number[r], ids[c], rounded(exact(r, c)))
        if self.waiting > self.n * self.k:
            self._reduce()

    def _hold(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        found = np.isfinite(scores)
        self.parts.append((rows[found], ids[found], scores[found]))
        self.waiting += int(found.sum())

    def _reduce(self) -> None:
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        by_id = _order(ids)
        order = by_id[np.lexsort((-scores[by_id], rows[by_id]))]
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        last = place == self.k - 1
        self.least[rows[last]] = scores[last]
        self.parts = [(rows[kept], ids[kept], scores[kept])]
        self.waiting = 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, identifier and score of all results."""
        if not self.parts:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=object), np.zeros(0)
        self._reduce()
        return self.parts[0]
