"""Small dense numerics on the driver, for matrices of states: components, reversible estimation, spectra, exponentials, simplex search, assignment."""

from __future__ import annotations

import numpy as np


def components(adjacency: np.ndarray) -> np.ndarray:
    """Label of each node's strongly connected component: nodes that reach each other, labelled in the order of their smallest node.

    Two depth-first passes, over the edges and over the reversed edges; every edge is followed twice.
    """
    n = len(adjacency)
    edges = np.asarray(adjacency) > 0
    onward = [np.flatnonzero(row).tolist() for row in edges]
    back = [np.flatnonzero(row).tolist() for row in edges.T]

    def visit(start: int, links: list[list[int]], seen: np.ndarray) -> list[int]:
        seen[start] = True
        stack, left = [(start, iter(links[start]))], []
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if not seen[other]:
                    seen[other] = True
                    stack.append((other, iter(links[other])))
                    break
            else:
                stack.pop()
                left.append(node)
        return left

    seen, order = np.zeros(n, bool), []
    for k in range(n):
        if not seen[k]:
            order += visit(k, onward, seen)
    seen, first = np.zeros(n, bool), np.zeros(n, int)
    for k in reversed(order):
        if not seen[k]:
            group = visit(k, back, seen)
            first[group] = min(group)
    return np.unique(first, return_inverse=True)[1]


def ergodic(counts: np.ndarray) -> np.ndarray:
    """Mapping old -> new (-1: dropped) to the strongly connected component whose columns hold most counts; ties: the lowest label."""
    label = components(counts)
    weight = np.bincount(label, weights=counts.sum(axis=0))
    keep = label == int(weight.argmax())
    return np.where(keep, np.cumsum(keep) - 1, -1)


def normalize_rows(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > np.finfo(np.float32).tiny)


def reversible_counts(counts: np.ndarray, rounds: int = 100_000, tolerance: float = 1e-12, prior: float = 0.0) -> np.ndarray:
    """Symmetric counts of the same total whose row-normalised matrix has the greatest likelihood among reversible ones.

    Fixed point of the stationarity condition: x_ij = (c_ij + c_ji) / (n_i / x_i + n_j / x_j), from the symmetrised counts, until no entry
    moves by more than its share ``tolerance``.
    """
    c = np.asarray(counts, float) + prior
    both, n = c + c.T, c.sum(axis=1)
    x = both / 2
    for _ in range(rounds):
        q = n / np.maximum(x.sum(axis=1), 1e-300)
        new = np.divide(both, q[:, None] + q[None, :], out=np.zeros_like(x), where=both > 0)
        done = (np.abs(new - x) <= tolerance * new).all()
        x = new
        if done:
            break
    return x * (c.sum() / x.sum()) if x.sum() else x


def reversible_likelihood(log_x: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the reversible model with symmetric entries exp(log_x), and its gradient."""
    x = np.exp(log_x)
    row = x.sum(axis=1)
    value = float((counts * log_x).sum() - (counts.sum(axis=1) * np.log(row)).sum())
    ratio = counts.sum(axis=1) / row
    return value, counts + counts.T - x * (ratio[:, None] + ratio[None, :])


def stationary(t: np.ndarray) -> np.ndarray:
    """Left eigenvector of the largest eigenvalue, summing to 1."""
    value, vector = np.linalg.eig(t.T)
    v = np.real(vector[:, int(np.real(value).argmax())])
    return v / v.sum()


def eigenvectors(t: np.ndarray, n: int, right: bool = False, normalized: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Top ``n`` eigenvalues by real part and left eigenvectors as columns; the first sums to 1. ``right`` divides by it.

    Signs are fixed so that the component of largest size is positive; ``normalized`` scales to left-right products of 1.
    """
    value, vector = np.linalg.eig(t.T)
    order = np.argsort(-np.real(value), kind="stable")[:n]
    value, vector = np.real_if_close(value[order]), np.real_if_close(vector[:, order])
    value, vector = np.real(value), np.real(vector).copy()
    vector[:, 0] /= vector[:, 0].sum()
    pi = vector[:, 0]
    for k in range(1, vector.shape[1]):
        vector[:, k] *= np.sign(vector[np.abs(vector[:, k]).argmax(), k]) or 1.0
        if normalized:
            vector[:, k] /= np.sqrt(abs((vector[:, k] ** 2 / pi).sum()))
    return value, vector / pi[:, None] if right else vector


def reversible_eigenvectors(t: np.ndarray, n: int, pi: np.ndarray | None = None, right: bool = False, normalized: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As ``eigenvectors`` for a reversible matrix, by the symmetric problem D^1/2 T D^-1/2."""
    pi = stationary(t) if pi is None else pi
    root = np.sqrt(pi)
    s = root[:, None] * t / root[None, :]
    value, vector = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-value, kind="stable")[:n]
    value, vector = value[order], vector[:, order] * root[:, None]
    vector[:, 0] /= vector[:, 0].sum()
    for k in range(1, vector.shape[1]):
        vector[:, k] *= np.sign(vector[np.abs(vector[:, k]).argmax(), k]) or 1.0
        if normalized:
            vector[:, k] /= np.sqrt(abs((vector[:, k] ** 2 / pi).sum()))
    return value, vector / vector[:, :1] if right else vector


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor sum, and squaring."""
    norm = np.abs(a).sum(axis=1).max() if a.size else 0.0
    squarings = max(0, int(np.ceil(np.log2(norm))) + 4) if norm > 0 else 0
    b = a / 2.0**squarings
    out = term = np.eye(len(a))
    for k in range(1, 18):
        term = term @ b / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def simplex(f, start: np.ndarray, rounds: int = 2000, size: float = 0.1, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Least value of ``f`` by downhill simplex from ``start``; deterministic."""
    n = len(start)
    points = [np.array(start, float)]
    for k in range(n):
        p = np.array(start, float)
        p[k] += size * (abs(p[k]) if p[k] else 1.0)
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        fr = f(reflected)
        if fr < values[0]:
            further = centre + 2 * (centre - points[-1])
            fe = f(further)
            points[-1], values[-1] = (further, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = centre + 0.5 * ((reflected if fr < values[-1] else points[-1]) - centre)
            fi = f(inner)
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        least, via, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            done[j0] = True
            free = ~done[1:]
            slack = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            via[1:][better] = j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def kabsch(mobile: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rotation (3 x 3) that brings centred ``mobile`` (atoms x 3) closest to centred ``target``: mobile @ R."""
    u, _, vt = np.linalg.svd(mobile.T @ target)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return u @ flip @ vt


def min_rmsd(frames: np.ndarray, target: np.ndarray) -> np.ndarray:
    """RMSD of each frame (n, atoms, 3) to ``target`` (atoms, 3) after the best translation and rotation, by singular values."""
    a = frames - frames.mean(axis=1, keepdims=True)
    b = target - target.mean(axis=0)
    m = np.einsum("nai,aj->nij", a, b)
    s = np.linalg.svd(m, compute_uv=False)
    s[:, 2] *= np.sign(np.linalg.det(m))
    inner = (a * a).sum(axis=(1, 2)) + (b * b).sum() - 2 * s.sum(axis=1)
    return np.sqrt(np.maximum(inner, 0) / a.shape[1])
