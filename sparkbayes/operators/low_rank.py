"""Inverse Hessians of quasi-Newton pairs as a diagonal plus a low rank, and Gaussians with such covariances.

With J pairs of N numbers, H = D + B C B' where D is the diagonal start, B = [D Y, S] has 2 J columns and C is 2 J by 2 J. A
thin QR of B, scaled by the root of D, gives factors for draws and densities in time N J^2; no N by N matrix is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


class LowRank:
    """H of a diagonal start and pairs (s, y): products, log-determinant, draws and log densities."""

    def __init__(self, alpha: np.ndarray, S: Sequence[np.ndarray], Y: Sequence[np.ndarray]):
        self.alpha = np.asarray(alpha, dtype=float)
        self.root = np.sqrt(self.alpha)
        n, J = len(self.alpha), len(S)
        s, y = np.array(S).reshape(J, n).T, np.array(Y).reshape(J, n).T
        sy = s.T @ y
        R = np.triu(sy)
        Ri = np.linalg.solve(R, np.eye(J)) if J else R
        self.B = np.concatenate([self.alpha[:, None] * y, s], axis=1)
        inner = np.diag(np.diag(sy)) + y.T @ (self.alpha[:, None] * y)
        self.C = np.block([[np.zeros((J, J)), -Ri], [-Ri.T, Ri.T @ inner @ Ri]])
        self.Q, r = np.linalg.qr(self.B / self.root[:, None])
        core = np.eye(r.shape[0]) + r @ self.C @ r.T
        self.L = np.linalg.cholesky((core + core.T) / 2)

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.alpha * v + self.B @ (self.C @ (self.B.T @ v))

    def logdet(self) -> float:
        return float(np.log(self.alpha).sum() + 2 * np.log(np.diag(self.L)).sum())

    def dense(self) -> np.ndarray:
        return np.diag(self.alpha) + self.B @ self.C @ self.B.T

    def moved(self, u: np.ndarray) -> np.ndarray:
        """Draws with covariance H (rows) of independent normal numbers."""
        along = u @ self.Q
        return self.root * (u + (along @ self.L.T - along) @ self.Q.T)

    def logq(self, u: np.ndarray) -> np.ndarray:
        """Log densities of what ``moved`` makes of u."""
        n = len(self.alpha)
        return -0.5 * ((u * u).sum(axis=1) + n * math.log(2 * math.pi) + self.logdet())
