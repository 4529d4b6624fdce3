"""Distances between two sets of vectors as numpy functions (rows x rows), for assignment, clustering and linkage under any metric."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (n, width), (m, width) -> (n, m); NaN where a distance is not defined.
Pairwise = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _blocked(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Pairwise:
    """``f`` of broadcast rows, over slices of the first set that keep the temporary arrays small."""

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        step = max(1, 2_000_000 // max(1, b.size))
        with np.errstate(divide="ignore", invalid="ignore"):
            for s in range(0, len(a), step):
                out[s : s + step] = f(a[s : s + step, None, :], b[None, :, :])
        return out

    return distance


def _shares(f: Callable[..., np.ndarray]) -> Pairwise:
    """``f`` of the counts true/true, true/false, false/true, false/false and the width."""

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (a != 0).astype(float), (b != 0).astype(float)
        tt = x @ y.T
        tf, ft = x.sum(axis=1)[:, None] - tt, y.sum(axis=1)[None, :] - tt
        n = float(a.shape[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            return f(tt, tf, ft, n - tt - tf - ft, n)

    return distance


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _blocked(lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=2)))(a, b)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])


def rmsd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root mean squared deviation of structures (rows: x, y, z of atom after atom) after the best superposition.

    The largest eigenvalue of the quaternion matrix is found from its characteristic polynomial, whose coefficients are the squared norm of
    the 3 x 3 correlation, its determinant and the squared norm of its cofactors, by Newton steps from a bound above it.
    """
    x, y = (m.reshape(len(m), -1, 3) for m in (a, b))
    x, y = (m - m.mean(axis=1, keepdims=True) for m in (x, y))
    c = np.stack([np.stack([x[:, :, i] @ y[:, :, j].T for j in range(3)], axis=-1) for i in range(3)], axis=-2)
    size = (x * x).sum(axis=(1, 2))[:, None] + (y * y).sum(axis=(1, 2))[None, :]
    cofactor = np.cross(c[..., [1, 2, 0], :], c[..., [2, 0, 1], :])
    norm = (c * c).sum(axis=(-2, -1))
    determinant = (c[..., 0, :] * cofactor[..., 0, :]).sum(axis=-1)
    constant = norm**2 - 4 * (cofactor**2).sum(axis=(-2, -1))
    top = np.minimum(size / 2, np.sqrt(3 * norm))
    for _ in range(60):
        value = ((top * top - 2 * norm) * top - 8 * determinant) * top + constant
        slope = (4 * top * top - 4 * norm) * top - 8 * determinant
        step = np.divide(value, slope, out=np.zeros_like(top), where=slope > 0)
        top = top - step
        if (np.abs(step) <= 1e-13 * np.abs(top)).all():
            break
    return np.sqrt(np.maximum(size - 2 * top, 0) / x.shape[1])


def mahalanobis(inverse: np.ndarray, squared: bool = False) -> Pairwise:
    inverse = np.asarray(inverse, float)

    def value(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x - y
        q = np.einsum("nmi,ij,nmj->nm", d, inverse, d)
        return q if squared else np.sqrt(np.maximum(q, 0))

    return _blocked(value)


def metric(name: str, p: float = 3.0, variances: list[float] | None = None, inverse: list[list[float]] | None = None) -> Pairwise:
    """A distance by name: the numeric and boolean ones of ``vectors``, ``seuclidean`` (``variances``), ``mahalanobis`` and ``sqmahalanobis``
    (``inverse`` covariance), and ``rmsd``. An unknown name is a TypeError, a missing parameter a ValueError."""
    if name == "seuclidean":
        if variances is None:
            raise ValueError("seuclidean needs variances")
        v = np.asarray(variances, float)
        return _blocked(lambda x, y: np.sqrt(((x - y) ** 2 / v).sum(axis=2)))
    if name in ("mahalanobis", "sqmahalanobis"):
        if inverse is None:
            raise ValueError(f"{name} needs the inverse covariance")
        return mahalanobis(np.asarray(inverse), name == "sqmahalanobis")
    if name == "minkowski":
        return _blocked(lambda x, y: (np.abs(x - y) ** p).sum(axis=2) ** (1 / p))
    if name not in NAMED:
        raise TypeError(f"no metric {name!r}; there are {sorted(NAMED)}")
    return NAMED[name]


NAMED: dict[str, Pairwise] = {
    "euclidean": euclidean,
    "sqeuclidean": _blocked(lambda x, y: ((x - y) ** 2).sum(axis=2)),
    "cityblock": _blocked(lambda x, y: np.abs(x - y).sum(axis=2)),
    "chebyshev": _blocked(lambda x, y: np.abs(x - y).max(axis=2)),
    "cosine": cosine,
    "correlation": lambda a, b: cosine(a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)),
    "braycurtis": _blocked(lambda x, y: np.abs(x - y).sum(axis=2) / np.abs(x + y).sum(axis=2)),
    "canberra": _blocked(lambda x, y: np.nan_to_num(np.abs(x - y) / (np.abs(x) + np.abs(y))).sum(axis=2)),
    "rmsd": rmsd,
    "matching": _shares(lambda tt, tf, ft, ff, n: (tf + ft) / n),
    "dice": _shares(lambda tt, tf, ft, ff, n: (tf + ft) / (2 * tt + tf + ft)),
    "kulsinki": _shares(lambda tt, tf, ft, ff, n: (tf + ft - tt + n) / (tf + ft + n)),
    "rogerstanimoto": _shares(lambda tt, tf, ft, ff, n: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "russellrao": _shares(lambda tt, tf, ft, ff, n: (n - tt) / n),
    "sokalmichener": _shares(lambda tt, tf, ft, ff, n: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "sokalsneath": _shares(lambda tt, tf, ft, ff, n: 2 * (tf + ft) / (tt + 2 * (tf + ft))),
    "yule": _shares(lambda tt, tf, ft, ff, n: np.nan_to_num(2 * tf * ft / (tt * ff + tf * ft))),
}


def hybrid(parts: list[tuple[Pairwise, slice, float]], p: float | None = None) -> Pairwise:
    """Weighted sum, or with ``p`` the p-norm, of distances over parts (slices) of the vectors; each weight counts once."""

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = [w * f(a[:, at], b[:, at]) for f, at, w in parts]
        return sum(d) if p is None else sum(x**p for x in d) ** (1 / p)

    return distance


def named(m: str | Pairwise | None) -> Pairwise:
    """A metric given by name, as a function, or not at all (Euclidean)."""
    return euclidean if m is None else metric(m) if isinstance(m, str) else m


def over_columns(m: object) -> bool:
    """Whether ``m`` is a metric of two columns (not of two arrays)."""
    if m is None or isinstance(m, str):
        return False
    try:
        return isinstance(m(F.col("a"), F.col("b")), Column)
    except Exception:  # an array function cannot take columns
        return False
