"""Follow-the-regularised-leader with elastic net, for sparse rows; one column of weights per class."""

from __future__ import annotations

import numpy as np


class FollowTheRegularisedLeader:
    """Proximal FTRL with a step size per weight.

    Weights are functions of the accumulated state: a weight stays exactly zero
    while its accumulated gradient is below ``l1``; ``l2`` shrinks the others.
    """

    def __init__(self, rows: int, columns: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((rows, columns))
        self.n = np.zeros((rows, columns))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """``at`` are distinct rows and ``weights`` what ``weights(at)`` gave."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = grown
