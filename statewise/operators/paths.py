"""Transition-path theory on a transition matrix: committors, fluxes, passage times, widest paths, hub scores, cut profiles."""

from __future__ import annotations

import heapq

import numpy as np

from statewise.functions import linalg


def _sets(sources, sinks) -> tuple[list[int], list[int]]:
    a = [int(x) for x in np.atleast_1d(sources)]
    b = [int(x) for x in np.atleast_1d(sinks)]
    if set(a) & set(b):
        raise ValueError("a state is both source and sink")
    return a, b


def committors(sources, sinks, t: np.ndarray) -> np.ndarray:
    """Probability to reach a sink before a source; 0 in sources, 1 in sinks."""
    a, b = _sets(sources, sinks)
    n = len(t)
    m, rhs = np.eye(n) - t, np.zeros(n)
    for s in a + b:
        m[s] = 0
        m[s, s] = 1
    rhs[b] = 1
    return np.clip(np.linalg.solve(m, rhs), 0, 1)


def fluxes(sources, sinks, t: np.ndarray, pi: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
    pi = linalg.stationary(t) if pi is None else pi
    q = committors(sources, sinks, t) if q is None else q
    f = (pi * (1 - q))[:, None] * t * q[None, :]
    np.fill_diagonal(f, 0)
    return f


def net_fluxes(sources, sinks, t: np.ndarray, pi: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
    f = fluxes(sources, sinks, t, pi, q)
    return np.maximum(0, f - f.T)


def mfpt(sinks, t: np.ndarray, lag: float = 1.0) -> np.ndarray:
    """Mean first passage time from every state to the sinks."""
    n = len(t)
    m, rhs = t - np.eye(n), -np.ones(n)
    for s in np.atleast_1d(sinks):
        m[s] = 0
        m[s, s] = 1
        rhs[s] = 0
    return lag * np.linalg.solve(m, rhs)


def all_mfpts(t: np.ndarray, pi: np.ndarray | None = None, lag: float = 1.0) -> np.ndarray:
    pi = linalg.stationary(t) if pi is None else pi
    z = np.linalg.inv(np.eye(len(t)) - t + pi[None, :])
    return lag * (np.diag(z)[None, :] - z) / pi[None, :]


def ensemble_mfpt(sources, sinks, t: np.ndarray, lag: float = 1.0) -> tuple[float, float]:
    """Mean and population deviation of the sources' passage times."""
    a, b = _sets(sources, sinks)
    x = mfpt(b, t, lag)[a]
    return float(x.mean()), float(x.std())


def path_times(sources, sinks, t: np.ndarray, lag: float = 1.0) -> tuple[float, float]:
    """Mean and deviation over the source states of the passage time after stepping out of the sources (rows renormalised)."""
    a, b = _sets(sources, sinks)
    p = np.array(t[a], float)
    p[:, a] = 0
    out = linalg.normalize_rows(p) @ mfpt(b, t, lag)
    out = out[out != 0]
    return float(out.mean()), float(out.std())


def fraction_visits(t: np.ndarray, waypoint: int, source: int, sink: int) -> float:
    """Share of the paths from source to sink that pass the waypoint."""
    to_sink = committors([source], [sink], t)
    first = committors([source, sink], [waypoint], t) if waypoint not in (source, sink) else None
    if first is None:
        return 1.0
    out = t[source].copy()
    out[source] = 0
    total = float(out @ to_sink)
    via = float(out @ first) * to_sink[waypoint]
    return via / total if total > 0 else 0.0


def hub_fractions(t: np.ndarray, waypoint: int, times: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """``fraction_visits`` of one waypoint for every (source, sink), NaN where two of the three are one state.

    No system is solved: with the mean passage times m, a state i reaches b before a with probability (m_ia + m_ab - m_ib) / (m_ab + m_ba), and
    leaves a for b before it returns with probability 1 / (pi_a (m_ab + m_ba)). From these follow, for the path out of a, the chances of
    meeting the waypoint first and of meeting the sink first.
    """
    w, m = waypoint, times
    round_trip = m + m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = 1 / (pi[:, None] * round_trip)
        way_to_sink = (m[w][:, None] + m - m[w][None, :]) / round_trip  # [a, b]: from w to b before a
        sink_to_way = ((m.T + m[:, w][:, None] - m[:, w][None, :]) / round_trip[:, w][:, None])  # [a, b]: from b to w before a
        first = (escape[:, w][:, None] - escape * sink_to_way) / (1 - way_to_sink * sink_to_way)
        share = first * way_to_sink / escape
    share[w, :] = share[:, w] = np.nan
    np.fill_diagonal(share, np.nan)
    return share


def hub_score(t: np.ndarray, waypoint: int, times: np.ndarray | None = None, pi: np.ndarray | None = None) -> float:
    """Mean share of the paths between two other states that pass the waypoint."""
    pi = linalg.stationary(t) if pi is None else pi
    return float(np.nanmean(hub_fractions(t, waypoint, all_mfpts(t, pi) if times is None else times, pi)))


def hub_scores(t: np.ndarray) -> np.ndarray:
    """The hub score of every state; the passage times are found once, a waypoint then costs the square of the states."""
    pi = linalg.stationary(t)
    times = all_mfpts(t, pi)
    return np.array([hub_score(t, w, times, pi) for w in range(len(t))])


def widest_path(sources, sinks, net: np.ndarray) -> tuple[list[int], float]:
    """The path from a source to a sink with the largest least edge, and that edge's flux; ties: the smaller states. Empty if none leads there."""
    a, b = _sets(sources, sinks)
    best = np.zeros(len(net))
    parent = np.full(len(net), -1)
    heap = [(-np.inf, s, -1) for s in sorted(a)]
    done = np.zeros(len(net), bool)
    goals = set(b)
    while heap:
        width, s, via = heapq.heappop(heap)
        if done[s]:
            continue
        done[s], best[s], parent[s] = True, -width, via
        if s in goals:
            path = [s]
            while parent[path[-1]] >= 0:
                path.append(int(parent[path[-1]]))
            return path[::-1], float(best[s])
        for n in np.flatnonzero(net[s] > 0).tolist():
            if not done[n]:
                heapq.heappush(heap, (max(width, -net[s, n]), n, s))
    return [], 0.0


def bottleneck(path: list[int], net: np.ndarray) -> tuple[int, int, float]:
    """The first edge of least flux on a path."""
    flows = [net[i, j] for i, j in zip(path, path[1:], strict=False)]
    k = int(np.argmin(flows))
    return path[k], path[k + 1], float(flows[k])


def top_paths(sources, sinks, t: np.ndarray, most: int = 10, wipe_nodes: bool = False, net: np.ndarray | None = None) -> list[tuple[list[int], float, int, int]]:
    """Up to ``most`` widest paths: after each, its bottleneck edge (or the edge's inner node) is removed. The search runs anew each time."""
    net = net_fluxes(sources, sinks, t) if net is None else np.array(net, float)
    fixed = set(np.atleast_1d(sources).tolist()) | set(np.atleast_1d(sinks).tolist())
    out = []
    while len(out) < most:
        path, width = widest_path(sources, sinks, net)
        if not path or width <= 0:
            break
        i, j, flow = bottleneck(path, net)
        out.append((path, flow, i, j))
        inner = [s for s in (i, j) if s not in fixed]
        if wipe_nodes and inner:
            net[inner[0]] = 0
            net[:, inner[0]] = 0
        else:
            net[i, j] = 0
    return out


# Cut-based profiles along a coordinate (one value per state).


def cut_profile(counts: np.ndarray, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States in coordinate order, their partition function (column sums) and the cut function: half the counts that cross each state's
    upper border, in either direction."""
    order = np.argsort(coordinate, kind="stable")
    c = counts[np.ix_(order, order)]
    zh = c.sum(axis=0)
    above = np.triu(c, 1) + np.tril(c, -1).T
    zc = np.cumsum(above.sum(axis=1) - above.sum(axis=0)) / 2
    return order, zh, zc


def natural_coordinate(counts: np.ndarray, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, natural coordinate (cumulated zh / (zc sqrt(pi))) and zc, where the cut function is above 0."""
    order, zh, zc = cut_profile(counts, coordinate)
    keep = zc > 1e-12
    return order[keep], np.cumsum(zh[keep] / (zc[keep] * np.sqrt(np.pi))), zc[keep]


def profile_mfpt(counts: np.ndarray, coordinate: np.ndarray, reactant: int, product: int, lag: float = 1.0) -> float:
    """Passage time from ``reactant`` to ``product`` by diffusion along the profile: lag / pi times the integral over the coordinate x from the
    reactant's value to the product's of zh(x) / zc(x)^2 times the integral of zh from the reactant's value to x.

    Both integrals are trapezoids between the states in coordinate order. Where no counts cross a state's upper border (as at the
    highest state) zc is taken from the border below. A product that is not above the reactant gives 0.
    """
    order, zh, zc = cut_profile(counts, coordinate)
    zc = np.where(zc > 1e-12, zc, np.r_[0.0, zc[:-1]])
    place = np.argsort(order)
    span = slice(place[reactant], place[product] + 1)
    x, zh, zc = np.asarray(coordinate, float)[order][span], zh[span], zc[span]
    if len(x) < 2:
        return 0.0
    step = np.diff(x)
    below = np.r_[0.0, np.cumsum(step * (zh[1:] + zh[:-1]) / 2)]
    inner = np.divide(zh * below, zc * zc, out=np.zeros(len(x)), where=zc > 1e-12)
    return float(lag / np.pi * (step * (inner[1:] + inner[:-1]) / 2).sum())


def profile_histogram(populations: np.ndarray, coordinate: np.ndarray, bins: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Lower bin edges and free energies -log(population) along a coordinate; empty bins are NaN."""
    weight, edges = np.histogram(coordinate, bins=bins, weights=populations)
    with np.errstate(divide="ignore"):
        return edges[:-1], np.where(weight > 0, -np.log(weight), np.nan)


def optimize_coordinate(function, start: np.ndarray, counts: np.ndarray, reactant: int, product: int, rounds: int = 300) -> np.ndarray:
    """Weights of a user coordinate (weights -> value per state) that make the profile's passage time longest."""
    best, _ = linalg.simplex(lambda w: -profile_mfpt(counts, function(w), reactant, product), np.asarray(start, float), rounds)
    return best
