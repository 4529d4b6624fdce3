"""Markov state models: estimation, spectra, propagation, sampling, kinetics. Arrays in, arrays out; ``statewise.plans`` has the tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from statewise.functions import linalg


@dataclass
class Model:
    counts: np.ndarray
    tprob: np.ndarray
    populations: np.ndarray
    mapping: np.ndarray


def build(counts: np.ndarray, symmetrize: str | None = "mle", trim: bool = True) -> Model:
    """Trim to the ergodic component, symmetrise (``mle``, ``transpose`` or none, in any case), normalise.

    Maximum likelihood without trimming is refused: it has no solution where a state cannot be left or reached.
    """
    kind = (symmetrize or "none").lower()
    if kind not in ("mle", "transpose", "none"):
        raise ValueError(f"unknown symmetrization {symmetrize!r}")
    if kind == "mle" and not trim:
        raise ValueError("maximum likelihood needs the trimmed states")
    counts = np.asarray(counts, float)
    mapping = linalg.ergodic(counts) if trim else np.arange(len(counts))
    kept = counts[np.ix_(mapping >= 0, mapping >= 0)]
    x = linalg.reversible_counts(kept) if kind == "mle" else (kept + kept.T) / 2 if kind == "transpose" else kept
    t = linalg.normalize_rows(x)
    pi = x.sum(axis=0) / x.sum() if kind != "none" else linalg.stationary(t)
    return Model(x, t, pi, mapping)


def is_transition_matrix(t: np.ndarray, epsilon: float = 1e-5) -> bool:
    return bool(np.sqrt(((t.sum(axis=1) - 1) ** 2).sum()) < epsilon)


def implied_timescales(counts: np.ndarray, lag: int, n: int, symmetrize: str | None = "mle", trim: bool = True) -> np.ndarray:
    """-lag / ln(eigenvalue) of the ``n`` slowest processes; eigenvalues that are not positive give NaN."""
    m = build(counts, symmetrize, trim)
    if (symmetrize or "none").lower() == "none":
        value, _ = linalg.eigenvectors(m.tprob, n + 1)
    else:
        value, _ = linalg.reversible_eigenvectors(m.tprob, n + 1, m.populations)
    value = value[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((value > 0) & (value < 1), -lag / np.log(value), np.nan)


def propagate(t: np.ndarray, start: np.ndarray, steps: int, observable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Populations after ``steps`` steps, and the observable's mean after 0..steps-1 steps."""
    p, series = np.asarray(start, float), []
    for _ in range(steps):
        if observable is not None:
            series.append(float(p @ observable))
        p = p @ t
    return p, np.array(series) if observable is not None else None


def project_observable(observable: np.ndarray, t: np.ndarray, modes: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Timescales -1 / ln(eigenvalue) and amplitudes (observable . right eigenvector) of the slowest modes."""
    value, right = linalg.eigenvectors(t, modes, right=True, normalized=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return -1 / np.log(value[1:]), observable @ right[:, 1:]


def expectation_series(t: np.ndarray, observable: np.ndarray, points: int, start: np.ndarray | None = None, modes: int = 100) -> np.ndarray:
    """Mean of the observable after 0..points-1 steps by modes with positive eigenvalues, from uniform populations by default."""
    n = len(t)
    start = np.full(n, 1 / n) if start is None else start
    value, left = np.linalg.eig(t.T)
    order = np.argsort(-np.real(value), kind="stable")[:modes]
    value, left = value[order], left[:, order]
    weight = np.linalg.pinv(left) @ start
    keep = np.real(value) > 0
    amplitude = (left.T @ observable) * weight
    return np.real((value[keep][None, :] ** np.arange(points)[:, None]) @ amplitude[keep])


def autocorrelation(t: np.ndarray, observable: np.ndarray, points: np.ndarray, modes: int = 10) -> np.ndarray:
    """Normalised autocorrelation of the observable from the non-stationary modes."""
    value, left = linalg.eigenvectors(t, modes, normalized=True)
    s = observable @ left[:, 1:]
    series = (np.maximum(value[1:], 0)[None, :] ** np.asarray(points)[:, None]) @ (s * s)
    return series / (s * s).sum()


def walk(t: np.ndarray, start: int | np.ndarray | None, steps: int, seed: int = 0) -> np.ndarray:
    """A chain of ``steps`` states: from a state, from a state drawn from a distribution, or from a state drawn at random."""
    rng = np.random.default_rng(seed)
    edges = np.cumsum(t, axis=1)
    if start is None:
        start = int(rng.integers(len(t)))
    elif not np.isscalar(start):
        start = int(np.searchsorted(np.cumsum(start), rng.random() * np.sum(start), side="right"))
    out = np.empty(steps, int)
    for k in range(steps):
        out[k] = start
        start = min(len(t) - 1, int(np.searchsorted(edges[start], rng.random() * edges[start, -1], side="right")))
    return out


def bad_eigenvalues(value: np.ndarray, decimal: int = 5, cutoff: float = 0.999999) -> list[str]:
    """What is odd about a spectrum: a first eigenvalue that is not 1, or a second one that is."""
    said = []
    if abs(value[0] - 1) > 1.5 * 10.0**-decimal:
        said.append("the first eigenvalue is not 1")
    if len(value) > 1 and value[1] > cutoff:
        said.append("the second eigenvalue is 1: the states are not connected")
    return said


def permuted(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    return a[np.ix_(order, order)]


# Fits of a rate matrix to counts under detailed balance.


def rates_of(t: np.ndarray) -> np.ndarray:
    k = np.array(t, float)
    np.fill_diagonal(k, 0)
    np.fill_diagonal(k, -k.sum(axis=1))
    return k


def free_rates(k: np.ndarray) -> list[tuple[int, int]]:
    """The entries (i > j) a fit may move: those that are not 0."""
    i, j = np.nonzero(np.tril(k, -1))
    return list(zip(i.tolist(), j.tolist(), strict=True))


def rates_from(parameters: np.ndarray, free: list[tuple[int, int]], pi: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Rate matrix with the free entries |parameter|, their mirrors by detailed balance, the rest from ``fixed``, rows summing to 0."""
    k = np.array(fixed, float)
    for (i, j), x in zip(free, parameters, strict=True):
        k[i, j] = abs(x)
        k[j, i] = abs(x) * pi[i] / pi[j]
    np.fill_diagonal(k, 0)
    np.fill_diagonal(k, -k.sum(axis=1))
    return k


def fix_rate(free: list[tuple[int, int]], parameters: np.ndarray, pi: np.ndarray, fixed: np.ndarray, i: int, j: int, value: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pin the rate i -> j and its mirror; the pair is no longer free."""
    out = np.array(fixed, float)
    out[i, j] = value
    out[j, i] = value * pi[i] / pi[j]
    pair = (max(i, j), min(i, j))
    keep = [n for n, p in enumerate(free) if p != pair]
    return [free[n] for n in keep], np.asarray(parameters)[keep], out


def fit_rates(counts: np.ndarray, pi: np.ndarray, start: np.ndarray, lag: float = 1.0, free: list[tuple[int, int]] | None = None, rounds: int = 2000) -> np.ndarray:
    """Rate matrix of greatest likelihood sum(C log exp(lag K)) by downhill simplex over the free entries."""
    free = free_rates(start) if free is None else free
    if not free:
        return rates_from(np.empty(0), free, pi, start)

    def loss(x: np.ndarray) -> float:
        t = linalg.expm(lag * rates_from(x, free, pi, start))
        return -float((counts * np.log(np.maximum(t, 1e-300))).sum())

    x, _ = linalg.simplex(loss, np.array([start[i, j] for i, j in free]), rounds)
    return rates_from(x, free, pi, start)


def log_likelihood(counts: np.ndarray, t: np.ndarray) -> float:
    some = counts > 0
    return float((counts[some] * np.log(t[some])).sum())
