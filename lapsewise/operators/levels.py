"""Scores that depend on time through the baseline hazard, evaluated at a fixed set of hazard levels.

``S_i(t) = exp(-L(t) r_i)`` depends on the time only through the level ``L(t)``. Sums of such terms over rows are
smooth in the level, so tasks evaluate them at Chebyshev nodes and any number of times is read off by interpolation.
The levels from zero to the largest are cut in panels that halve towards zero, so the number of nodes grows with the
logarithm of the largest level times the largest rate and with nothing else; the error is that of rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes in a panel. On a panel [a, 2a] the error of a term falls like 6 ** -NODES for any rate.
NODES = 24
_TURN = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
_SPOT = np.cos(_TURN)
_BARY = np.where(np.arange(NODES) % 2 == 0, 1.0, -1.0) * np.sin(_TURN)
#: ``exp`` of a larger score does not fit a double with room to spare; survival is zero there at any level above zero.
TOP_SCORE = 690.0


def rates(score: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(score, TOP_SCORE))


@dataclass(frozen=True)
class Panels:
    """Panels ``[low, high]``, highest first; ``at`` holds the nodes of all panels in that order, none of them zero."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray

    @staticmethod
    def over(top: float, rate: float) -> Panels:
        """Panels from zero to ``top`` for terms ``exp(-level * x)`` with ``x`` up to ``rate``."""
        edges = [top if top > 0 else 1.0]
        while edges[-1] * rate > 8:
            edges.append(edges[-1] / 2)
        high = np.array(edges)
        low = np.append(high[1:], 0.0)
        at = ((high + low)[:, None] + (high - low)[:, None] * _SPOT) / 2
        return Panels(low, high, at.ravel())

    def weights(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Panel of each level, and the weights of the panel's nodes."""
        own = len(self.high) - 1 - np.searchsorted(self.high[::-1], level, side="left").clip(0, len(self.high) - 1)
        low, high = self.low[own], self.high[own]
        gap = ((2 * level - low - high) / (high - low))[:, None] - _SPOT
        hit = gap == 0
        share = _BARY / np.where(hit, 1.0, gap)
        share = np.where(hit.any(1)[:, None], hit.astype(float), share)
        return own, share / share.sum(1)[:, None]

    def read(self, level: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Value at each level: ``values`` has one row of node values for all levels, or one per level."""
        out = np.empty(len(level))
        table = values.reshape(-1, len(self.high), NODES)
        for s in range(0, len(level), 8192):
            k = slice(s, s + 8192)
            own, share = self.weights(level[k])
            rows = np.arange(len(level))[k] if len(table) > 1 else np.zeros(len(own), dtype=int)
            out[k] = (table[rows, own] * share).sum(1)
        return out
