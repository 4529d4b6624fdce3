import itertools

import numpy as np
import pytest

from statewise.functions import linalg
from statewise.operators import lumping, model, paths


def chain(n, seed=0):
    c = np.random.default_rng(seed).integers(1, 30, (n, n)).astype(float)
    return linalg.normalize_rows(c + c.T)


def test_reversible_counts():
    assert np.allclose(linalg.reversible_counts(np.array([[10.0, 5], [5, 10]])), [[10, 5], [5, 10]])
    x = linalg.reversible_counts(np.array([[10.0, 5, 1], [0, 25, 10], [3, 3, 100]]))
    assert np.allclose(x, x.T) and x.sum() == pytest.approx(157)
    _, gradient = linalg.reversible_likelihood(np.log(x), np.array([[10.0, 5, 1], [0, 25, 10], [3, 3, 100]]))
    upper = gradient[np.triu_indices(3, 1)] + gradient.T[np.triu_indices(3, 1)]
    assert np.abs(upper).max() < 1e-5


def test_trim_keeps_the_largest_component():
    m = model.build(np.array([[2.0, 1, 0], [1, 2, 0], [0, 0, 1]]))
    assert m.mapping.tolist() == [0, 1, -1] and m.tprob.shape == (2, 2)
    with pytest.raises(ValueError):
        model.build(np.eye(2), "MLE", trim=False)


def test_eigenvectors():
    t = chain(8)
    value, left = linalg.eigenvectors(t, 4)
    assert np.allclose(left.T @ t, value[:, None] * left.T)
    v2, l2 = linalg.reversible_eigenvectors(t, 4)
    assert np.allclose(value, v2) and np.allclose(left[:, 0], l2[:, 0])
    _, r = linalg.reversible_eigenvectors(t, 4, right=True, normalized=True)
    _, ln = linalg.reversible_eigenvectors(t, 4, normalized=True)
    assert np.allclose(ln.T @ r, np.eye(4), atol=1e-8)


def test_propagation_and_correlation():
    t = (chain(5, 1) + np.eye(5)) / 2
    p, series = model.propagate(t, np.eye(5)[0], 50, np.arange(5.0))
    assert np.allclose(p, linalg.stationary(t)) and len(series) == 50
    assert np.allclose(model.expectation_series(t, np.arange(5.0), 6, np.eye(5)[0])[:6], series[:6])
    acf = model.autocorrelation(t, np.arange(5.0), np.arange(4), modes=5)
    pi, a = linalg.stationary(t), np.arange(5.0) - linalg.stationary(t) @ np.arange(5.0)
    direct = [(pi * a) @ np.linalg.matrix_power(t, k) @ a for k in range(4)]
    assert np.allclose(acf, np.array(direct) / direct[0])
    assert acf[0] == pytest.approx(1)


def test_committors_and_times():
    t = chain(6, 2)
    q = paths.committors([0], [5], t)
    inner = slice(1, 5)
    assert np.allclose(q[inner], (t @ q)[inner]) and q[0] == 0 and q[5] == 1
    f = paths.fluxes(0, 5, t)
    net = paths.net_fluxes(0, 5, t)
    assert (net >= 0).all() and np.allclose(net.sum(axis=0)[inner], net.sum(axis=1)[inner])
    assert f.trace() == 0
    assert np.allclose(paths.all_mfpts(t)[:, 5], paths.mfpt(5, t))
    with pytest.raises(ValueError):
        paths.committors([0, 1], [1], t)


def test_fraction_visits_by_enumeration():
    t = chain(4, 3)
    rng = np.random.default_rng(0)
    through = total = 0
    for _ in range(4000):
        s, seen = 0, False
        while True:
            s = rng.choice(4, p=t[s])
            seen |= s == 1
            if s == 3:
                total += 1
                through += seen
                break
            if s == 0:
                seen = False
    assert paths.fraction_visits(t, 1, 0, 3) == pytest.approx(through / total, abs=0.03)
    assert len(paths.hub_scores(t)) == 4


def test_widest_path_by_enumeration():
    net = np.triu(np.random.default_rng(4).random((6, 6)), 1)
    best = max(min(net[i, j] for i, j in itertools.pairwise((0, *p, 5))) for k in range(5) for p in itertools.permutations(range(1, 5), k))
    path, width = paths.widest_path(0, 5, net)
    assert width == pytest.approx(best) and path[0] == 0 and path[-1] == 5
    found = paths.top_paths(0, 5, None, 4, net=net)
    assert [f for _, f, *_ in found] == sorted((f for _, f, *_ in found), reverse=True)
    assert paths.widest_path(5, 0, net) == ([], 0.0)


def test_exponential_and_rates():
    t = chain(4, 5)
    k = model.rates_of(t)
    assert np.allclose(linalg.expm(k).sum(axis=1), 1)
    pi = linalg.stationary(t)
    fitted = model.fit_rates(1000 * pi[:, None] * linalg.expm(k), pi, 1.3 * k, rounds=3000)
    assert np.allclose(fitted, k, atol=0.02)
    free, x, fixed = model.fix_rate(model.free_rates(k), np.ones(6), pi, k, 0, 1, 0.2)
    assert len(free) == len(x) == 5 and fixed[0, 1] == 0.2


def blocks():
    t = np.full((9, 9), 0.002)
    for b in range(3):
        t[3 * b : 3 * b + 3, 3 * b : 3 * b + 3] = 0.3
    return linalg.normalize_rows(t)


@pytest.mark.parametrize("method", ["pcca", "pcca_plus", "bace"])
def test_lumping_finds_blocks(method):
    t = blocks() + np.diag(np.linspace(0, 0.02, 9))
    t = linalg.normalize_rows(t + t.T)
    label = lumping.pcca(t, 3) if method == "pcca" else lumping.pcca_plus(t, 3)[0] if method == "pcca_plus" else lumping.bace(np.round(t * 3000), 3)[0]
    assert len({tuple(np.flatnonzero(label == k)) for k in set(label)} & {(0, 1, 2), (3, 4, 5), (6, 7, 8)}) == 3


def test_assignment_and_rmsd():
    cost = np.random.default_rng(0).random((5, 7))
    best = min(cost[range(5), list(p)].sum() for p in itertools.permutations(range(7), 5))
    assert cost[range(5), linalg.assignment(cost)].sum() == pytest.approx(best)
    x = np.random.default_rng(1).normal(size=(6, 3))
    a = 0.7
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    assert linalg.min_rmsd(np.array([x @ turn + 3, -x]), x)[0] == pytest.approx(0, abs=1e-7)


def test_cut_profile():
    c = np.array([[5.0, 2, 1], [2, 6, 3], [1, 3, 7]])
    order, zh, zc = paths.cut_profile(c, np.array([0.0, 1, 2]))
    assert order.tolist() == [0, 1, 2] and zh.tolist() == [8, 11, 11] and np.allclose(zc, [3, 4, 0])
