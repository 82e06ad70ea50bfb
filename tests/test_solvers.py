import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.functions.spectral import rotation_bound, tolerance_margin, ulp_distance
from lumenfold.plans import solvers as S
from lumenfold.plans.config import ComputeMode, SpectralConfig, TooFewNodes


def ring(n, reach=1):
    i = np.repeat(np.arange(n), 2 * reach)
    d = np.tile(np.r_[np.arange(1, reach + 1), -np.arange(1, reach + 1)], n)
    return i, (i + d) % n, np.ones(len(i))


def clique(n, at=0):
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    return i + at, j + at, np.ones(len(i))


def lap(graph, n):
    return S.laplacian_of(*graph, n)


def test_ring_and_clique_in_closed_form():
    a, root = lap(ring(60), 60)
    got = S.solve(a, 4, 1, root)
    want = np.sort(1 - np.cos(2 * np.pi * np.arange(60) / 60))[:5]
    assert got.level == 0 and np.allclose(got.values, want, atol=1e-12)
    b, root = lap(clique(20), 20)
    assert np.allclose(S.solve(b, 2, 1, root).values, [0, 20 / 19, 20 / 19], atol=1e-12)


def test_two_cliques_have_two_zeros():
    g = [np.concatenate(x) for x in zip(clique(8), clique(8, 8), strict=True)]
    values = S.dense_evd(lap(g, 16)[0], 3)[0]
    assert np.allclose(values[:2], 0, atol=1e-12) and values[2] > 0.5


@settings(max_examples=25, deadline=None)
@given(n=st.integers(50, 200), seed=st.integers(0, 1000))
def test_invariants_on_rings(n, seed):
    a, root = lap(ring(n), n)
    got = S.lobpcg(a, 2, seed, root)
    assert got is not None
    (values, x), _ = got
    assert (np.diff(values) >= -1e-12).all() and values.min() >= -1e-12 and values.max() <= 2 + 1e-12
    assert values[0] < 1e-9 and S.worst_residual(a, (values, x)) < 1e-4
    assert np.abs(x.T @ x - np.eye(3)).max() < 1e-8 and np.isfinite(x).all() and x.var(0)[1:].min() > 0
    again = S.lobpcg(a, 2, seed, root)[0]
    assert (again[1] == x).all()


def test_levels_agree_on_a_subspace():
    rng = np.random.default_rng(3)
    n = 300
    i, j, w = ring(n, 2)
    w = 0.5 + rng.random(n * 4)
    full = np.zeros((n, n))
    full[i, j] = w
    full = (full + full.T) / 2
    i, j = np.nonzero(full)
    a, root = lap((i, j, full[i, j]), n)
    values, x = S.dense_evd(a, 3)
    for got, tol in ((S.lobpcg(a, 2, 5, root)[0], 1e-4), (S.shift_invert(a, 2, 5, root), 1e-6), (S.shift_invert(a, 2, 5, root, cholesky_below=1), 1e-5), (S.lobpcg(a, 2, 5, root, regularize=True)[0], 1e-4), (S.rsvd_accurate(a, 2, 5, size=120, power=40), 1e-2)):
        assert np.allclose(got[0], values, atol=tol)
        assert np.linalg.svd(x.T @ np.linalg.qr(got[1])[0], compute_uv=False).min() > 0.95
    assert len(S.rsvd(a, 2, 5)[0]) == 3


def test_chain_goes_on_where_a_gate_is_missed(monkeypatch):
    a, root = lap(ring(40), 40)
    config = SpectralConfig(dense_below=0)
    assert S.solve(a, 2, 1, root, config).level == 1
    monkeypatch.setattr(S, "lobpcg", lambda *x, **k: None)
    assert S.solve(a, 2, 1, root, config).level == 2
    monkeypatch.setattr(S, "shift_invert", lambda *x, **k: None)
    got = S.solve(a, 2, 1, root, config)
    assert got.level in (4, 5) and got.residual < 1e-2 or got.level == 5
    monkeypatch.setattr(S, "rsvd", lambda *x, **k: S.dense_evd(lap(ring(40, 3), 40)[0], 3))
    assert S.solve(a, 2, 1, root, config).level == 5


def test_sizes_and_errors():
    assert [S.subspace_size(n, 3) for n in (3, 5, 20, 100, 1000)] == [3, 5, 8, 13, 103]
    a, root = lap((np.array([0, 1]), np.array([1, 0]), np.ones(2)), 2)
    with pytest.raises(TooFewNodes):
        S.solve(a, 2, 1, root)
    with pytest.raises(TooFewNodes):
        S.dense_evd(a, 3)
    assert S.lobpcg(a, 1, 1, root) is None and S.shift_invert(a, 1, 1, root) is None


def test_filter_is_the_polynomial():
    a, _ = lap(ring(30), 30)
    values, x = np.linalg.eigh(a.dense())
    t = (values - 1.05) / 0.95
    want = x @ (np.cos(8 * np.arccos(np.clip(t, -1, 1))) * (np.abs(t) <= 1) + np.where(np.abs(t) > 1, np.cosh(8 * np.arccosh(np.maximum(1, np.abs(t)))), 0))
    got = S.chebyshev(a.apply, x @ np.ones((30, 1)))
    assert np.allclose(got[:, 0], want, atol=1e-8)


def test_isolated_nodes_self_loops_and_modes():
    i, j, w = np.array([0, 1, 1]), np.array([1, 0, 1]), np.array([1.0, 1.0, 3.0])
    a, root = S.laplacian_of(i, j, w, 3)
    assert np.allclose(root, [1, 2, 0]) and np.allclose(a.dense(), [[1, -0.5, 0], [-0.5, 1, 0], [0, 0, 1]])
    rng = np.random.default_rng(1)
    i, j, w = ring(50, 3)
    w = rng.random(len(w)).astype(np.float32)
    f32, f64 = S.laplacian_of(i, j, w, 50)[1], S.laplacian_of(j, i, w, 50, compat=False)[1]
    assert np.allclose(f32, f64, rtol=1e-6) and not (f32 == f64).all()


def test_embed_component_signs():
    i, j, w = ring(30)
    x, _ = S.embed_component(i, j, w, 30, 2, 42, SpectralConfig(compute_mode=ComputeMode.NATIVE))
    assert (x[np.abs(x).argmax(0), [0, 1]] > 0).all()


def test_small_helpers(monkeypatch):
    assert ulp_distance(np.array([1.0, 0.0]), np.array([np.nextafter(1.0, 2), -0.0])).tolist() == [1, 0]
    assert tolerance_margin(1e-5, 0) == np.inf and tolerance_margin(1e-5, 1e-6) == pytest.approx(10)
    assert rotation_bound(10, 100, 0.5) == pytest.approx(2000 * np.finfo(float).eps)
    monkeypatch.setenv("LUMENFOLD_DENSE_BELOW", "7")
    assert SpectralConfig.from_env().dense_below == 7 and SpectralConfig.from_env(dense_below=9).dense_below == 9
