"""Eigensolvers for the smallest pairs of a Laplacian that fits one task (D3 to D22), in numpy.

A solver gives (values ascending, vectors as columns), the trivial pair included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lumenfold.functions.spectral import DENSE_GATE, LOBPCG_GATE, LOBPCG_TOL, RSVD_GATE, SINV_GATE, SINV_TOL
from lumenfold.plans.config import ConvergenceFailure, SpectralConfig, TooFewNodes

Pairs = tuple[np.ndarray, np.ndarray]

# The start filter, restarts, iteration caps, regularisation and shift of the solver chain.
FILTER_LOW, FILTER_HIGH, FILTER_DEGREE, FILTER_FROM = 0.1, 2.0, 8, 1000
REGULARIZATION, SHIFT = 1e-5, 1e-4
RESTARTS, FIRST_CAP, RESTART_CAP, CAP_PER_NODE = 3, 300, 1000, 5
#: Columns beyond those asked for that an iteration carries along.
GUARD = 4


class Csr:
    """A square sparse matrix by rows; ``apply`` multiplies a vector or a block of columns."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int):
        order = np.lexsort((j, i))
        self.n, self.cols, self.data = n, np.asarray(j)[order], np.asarray(v, dtype=np.float64)[order]
        counts = np.bincount(np.asarray(i)[order], minlength=n)
        self.rows = np.repeat(np.arange(n), counts)
        self.filled = np.flatnonzero(counts)
        self.starts = np.r_[0, np.cumsum(counts)[:-1]][self.filled]

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x, dtype=np.float64)
        if len(self.data):
            if x.ndim == 1:
                out[self.filled] = np.add.reduceat(self.data * x[self.cols], self.starts)
            else:
                out[self.filled] = np.add.reduceat(self.data[:, None] * x[self.cols], self.starts, axis=0)
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (self.rows, self.cols), self.data)
        return out


def laplacian_of(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, compat: bool = True) -> tuple[Csr, np.ndarray]:
    """Normalised Laplacian and square roots of degrees of an edge list."""
    if compat:
        deg = np.zeros(n, dtype=np.float32)
        order = np.lexsort((j, i))
        np.add.at(deg, np.asarray(j)[order], np.asarray(w, dtype=np.float32)[order])
        deg = deg.astype(np.float64)
    else:
        deg = np.bincount(i, np.asarray(w, dtype=np.float64), n)
    root = np.sqrt(deg)
    inv = np.divide(1.0, root, out=np.zeros(n), where=root > 0)
    off = i != j
    i, j, w = np.asarray(i)[off], np.asarray(j)[off], np.asarray(w, dtype=np.float64)[off]
    every = np.arange(n)
    return Csr(np.r_[i, every], np.r_[j, every], np.r_[-inv[i] * w * inv[j], np.ones(n)], n), root


def worst_residual(lap: Csr, pairs: Pairs) -> float:
    values, x = pairs
    r = lap.apply(x) - x * values
    each = np.sqrt((r * r).sum(0)) / np.maximum(np.sqrt((x * x).sum(0)), 1e-300)
    return float(np.nan if np.isnan(each).any() else each.max())


def _check(n: int, k: int) -> None:
    if k > n:
        raise TooFewNodes(n, k - 1)


def dense_evd(lap: Csr, k: int) -> Pairs:
    _check(lap.n, k)
    values, vectors = np.linalg.eigh(lap.dense())
    return values[:k], vectors[:, :k]


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], x: np.ndarray, low: float = FILTER_LOW, high: float = FILTER_HIGH, degree: int = FILTER_DEGREE) -> np.ndarray:
    """T_degree((A - c) / e) x on the interval low .. high: what lies outside it grows."""
    c, e = (high + low) / 2, (high - low) / 2
    before, now = x, (apply(x) - c * x) / e
    for _ in range(degree - 1):
        before, now = now, 2 * (apply(now) - c * now) / e - before
    return now if degree else x


def rayleigh_ritz(apply: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> Pairs:
    q, _ = np.linalg.qr(x)
    g = q.T @ apply(q)
    values, rotation = np.linalg.eigh((g + g.T) / 2)
    return values, q @ rotation


def _iterate(apply: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tol: float, cap: int, wanted: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Locally optimal block iteration for the smallest pairs, from the columns of x.

    It ends when the first ``wanted`` pairs have converged; the columns beyond them guard the rate.
    """
    k, n = x.shape[1], x.shape[0]
    values, x = rayleigh_ritz(apply, x)
    ax, p = apply(x), np.zeros((n, 0))
    for _ in range(cap):
        r = ax - x * values
        norms = np.sqrt((r * r).sum(0))
        if (norms[:wanted] < tol).all():
            return values, x, True
        basis = np.concatenate([x, r / np.maximum(norms, 1e-300), p], axis=1)
        q, t = np.linalg.qr(basis)
        keep = np.abs(np.diag(t)) > 1e-12
        keep[:k] = True
        q = q[:, keep]
        aq = apply(q)
        g = q.T @ aq
        values_all, rotation = np.linalg.eigh((g + g.T) / 2)
        c = rotation[:, :k]
        values = values_all[:k]
        rest = c.copy()
        rest[:k] = 0
        p = q @ rest
        scale = np.sqrt((p * p).sum(0))
        p = p[:, scale > 1e-14] / scale[scale > 1e-14]
        x, ax = q @ c, aq @ c
    return values, x, False


def _start(n: int, k: int, seed: int, sqrt_deg: np.ndarray) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((n, k + max(0, min(GUARD, n // 3 - k))))
    norm = np.linalg.norm(sqrt_deg)
    if norm > 0:
        x[:, 0] = sqrt_deg / norm
    return x


def lobpcg(lap: Csr, dims: int, seed: int, sqrt_deg: np.ndarray, *, regularize: bool = False, tol: float = LOBPCG_TOL, filter_low: float = FILTER_LOW) -> tuple[Pairs, int] | None:
    """Smallest pairs and the restarts taken; None if there are too few nodes for the block.

    The trivial vector is put in analytically.  From FILTER_FROM nodes on the start is filtered once
    and column norms restored.  The best result is returned even where it has not converged; pairs
    are those of L itself, also if the iteration ran on L + REGULARIZATION I.
    """
    n, k = lap.n, dims + 1
    if n < 3 * k:
        return None
    shift = REGULARIZATION if regularize else 0.0
    apply = (lambda x: lap.apply(x) + shift * x) if shift else lap.apply
    x = _start(n, k, seed, sqrt_deg)
    if n >= FILTER_FROM:
        x = (x + chebyshev(apply, x, low=filter_low)) / 2
        x /= np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    best, restarts = None, 0
    for attempt in range(RESTARTS + 1):
        cap = min(CAP_PER_NODE * n, FIRST_CAP if attempt == 0 else RESTART_CAP)
        _, x, done = _iterate(apply, x, tol, cap, k)
        values, x = rayleigh_ritz(lap.apply, x)
        worst = worst_residual(lap, (values[:k], x[:, :k]))
        if best is None or worst < best[0]:
            best = worst, values[:k], x[:, :k]
        restarts = attempt
        if done:
            break
    return (np.maximum(best[1], 0.0) if best[1].min() > -1e-12 else best[1], best[2]), restarts


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tol: float, cap: int) -> np.ndarray:
    """A x = b for each column, together."""
    x, r = np.zeros_like(b), b.copy()
    p, rs = r.copy(), (r * r).sum(0)
    goal = tol * tol * rs
    for _ in range(cap):
        if (rs <= goal).all():
            break
        ap = apply(p)
        a = rs / np.maximum((p * ap).sum(0), 1e-300)
        x += a * p
        r -= a * ap
        new = (r * r).sum(0)
        p = r + new / np.maximum(rs, 1e-300) * p
        rs = new
    return x


def shift_invert(lap: Csr, dims: int, seed: int, sqrt_deg: np.ndarray, *, cholesky_below: int = 6000) -> Pairs | None:
    """Largest pairs of (L + SHIFT I)^-1: by a Cholesky factor for moderate n, by conjugate gradients
    beyond; eigenvalue 1 / mu - SHIFT, ascending.  None if the factor or the block is impossible."""
    n, k = lap.n, dims + 1
    if n < 3 * k:
        return None
    if n < cholesky_below:
        a = lap.dense()
        a[np.arange(n), np.arange(n)] += SHIFT
        try:
            half = np.linalg.inv(np.linalg.cholesky((a + a.T) / 2))
        except np.linalg.LinAlgError:
            return None
        solve = lambda b: half.T @ (half @ b)
    else:
        solve = lambda b: conjugate_gradients(lambda x: lap.apply(x) + SHIFT * x, b, SINV_TOL, 4 * n)
    x = _start(n, k, seed, sqrt_deg)
    _, x, _ = _iterate(lambda b: -solve(b), x, SINV_TOL, min(CAP_PER_NODE * n, FIRST_CAP), k)
    values, x = rayleigh_ritz(lambda b: -solve(b), x)
    values = 1 / -values - SHIFT
    order = np.argsort(values, kind="stable")[:k]
    return values[order], x[:, order]


def subspace_size(n: int, rank: int) -> int:
    """rank plus a tenth of n, at least max(rank, 5) and at most n - rank more, never over n."""
    more = min(max(n // 10, max(rank, 5)), max(n - rank, 0))
    return min(n, rank + more)


def _range_of(lap: Csr, size: int, power: int, seed: int) -> np.ndarray:
    """Orthonormal basis of the dominant range of 2I - L by a Gaussian sketch and power passes."""
    m = lambda x: 2 * x - lap.apply(x)
    q, _ = np.linalg.qr(m(np.random.default_rng(seed).standard_normal((lap.n, size))))
    for _ in range(power):
        q, _ = np.linalg.qr(m(q))
        q, _ = np.linalg.qr(m(q))
    return q


def rsvd(lap: Csr, dims: int, seed: int, *, oversampling: int | None = None, power: int = 2) -> Pairs:
    """Randomised solve on 2I - L: the largest values of it are 2 minus the smallest of L."""
    n, k = lap.n, dims + 1
    _check(n, k)
    size = min(n, k + oversampling) if oversampling is not None else subspace_size(n, k)
    q = _range_of(lap, size, power, seed)
    b = q.T @ (2 * q - lap.apply(q))
    values, rotation = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return 2 - values[order], q @ rotation[:, order]


def rsvd_accurate(lap: Csr, dims: int, seed: int, *, size: int | None = None, power: int = 2) -> Pairs:
    """As rsvd, with L itself projected on the basis."""
    n, k = lap.n, dims + 1
    _check(n, k)
    values, x = rayleigh_ritz(lap.apply, _range_of(lap, min(n, size or subspace_size(n, k)), power, seed))
    return values[:k], x[:, :k]


@dataclass(frozen=True)
class Solved:
    values: np.ndarray
    vectors: np.ndarray
    level: int
    residual: float


GATES = (DENSE_GATE, LOBPCG_GATE, SINV_GATE, LOBPCG_GATE, RSVD_GATE, np.inf)


def run_level(level: int, lap: Csr, dims: int, seed: int, sqrt_deg: np.ndarray, config: SpectralConfig) -> Pairs | None:
    """One solver of the chain; None where it cannot be run.

    0 dense, 1 block iteration, 2 shift and invert, 3 regularised iteration, 4 randomised, 5 dense.
    """
    if level in (0, 5):
        return dense_evd(lap, dims + 1)
    if level == 2:
        return shift_invert(lap, dims, seed, sqrt_deg)
    if level == 4:
        return rsvd(lap, dims, seed, oversampling=config.rsvd_oversampling, power=config.rsvd_power_iterations)
    got = lobpcg(lap, dims, seed, sqrt_deg, regularize=level == 3)
    return got and got[0]


def solve(lap: Csr, dims: int, seed: int, sqrt_deg: np.ndarray, config: SpectralConfig | None = None) -> Solved:
    """The chain of solvers: each level is accepted if its worst residual is under its gate.

    Level 0 is for small n; level 5 has no gate, but makes a dense matrix, so that graphs of more
    than ``dense_most`` nodes end in ConvergenceFailure instead.
    """
    config = config or SpectralConfig()
    _check(lap.n, dims + 1)
    worst = np.inf
    for level in range(0 if lap.n < config.dense_below else 1, 6):
        if level == 5 and lap.n > config.dense_most:
            break
        try:
            pairs = run_level(level, lap, dims, seed, sqrt_deg, config)
        except np.linalg.LinAlgError:
            continue
        if pairs is None:
            continue
        worst = worst_residual(lap, pairs)
        if worst < GATES[level] or level == 5:
            return Solved(*pairs, level, worst)
    raise ConvergenceFailure(f"no solver took {lap.n} nodes; the last residual is {worst:g}")


def embed_component(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, dims: int, seed: int, config: SpectralConfig) -> tuple[np.ndarray, Solved]:
    """Signed coordinates (n, dims) of a connected graph, and its solve."""
    lap, root = laplacian_of(i, j, w, n, compat=config.compute_mode.value == "compat")
    solved = solve(lap, dims, seed, root, config)
    order = np.argsort(solved.values, kind="stable")[1 : dims + 1]
    x = solved.vectors[:, order]
    lead = x[np.abs(x).argmax(0), np.arange(dims)]
    return np.where(lead < 0, -x, x), solved
