"""Structures of frames: aligned coordinates, RMSD over permutable atoms, surface areas, network and structure export."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions import framecodec, linalg

#: Radii in nm by element, and of the probe (fixed values).
RADII = {"H": 0.12, "C": 0.17, "N": 0.155, "O": 0.152, "S": 0.18, "P": 0.18}
PROBE = 0.14


def element(name: str) -> str:
    letters = name.lstrip("0123456789")
    return letters[:1] if letters[:1] in RADII else "C"


def _per_frame(frames: DataFrame, keys: list[str], n_atoms: int, out: str, build) -> DataFrame:
    """``keys`` and one array of doubles per complete, finite frame."""
    source = frames.select(*keys, "xyz")
    schema = ", ".join(f"{k} {t}" for k, t in source.dtypes if k in keys) + f", {out} array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = framecodec.from_lists(batch.column("xyz"), n_atoms)
            fine = np.isfinite(x).all(axis=(1, 2))
            keep[np.flatnonzero(keep)[~fine]] = False
            values = build(x[fine]) if fine.any() else np.empty((0, 1))
            width = values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, width), dtype=np.int32)[: len(values) + 1]), pa.array(values.ravel()))
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[some.column(k) for k in keys], lists], [*keys, out])

    return source.mapInArrow(run, schema)


def aligned(frames: DataFrame, target: np.ndarray, keys: list[str], align: list[int] | None = None, atoms: list[int] | None = None) -> DataFrame:
    """``keys, features``: coordinates of ``atoms`` as a flat vector after superposing ``align`` atoms onto the target."""
    n = len(target)
    on = list(range(n)) if align is None else align
    pick = list(range(n)) if atoms is None else atoms
    goal = target[on] - target[on].mean(axis=0)

    def build(x: np.ndarray) -> np.ndarray:
        c = x[:, on].mean(axis=1, keepdims=True)
        return ((x[:, pick] - c) @ rotations(x[:, on] - c, goal)).reshape(len(x), -1)

    return _per_frame(frames, keys, n, "features", build)


def rotations(mobile: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rotation of each centred frame (n, atoms, 3) onto one centred target."""
    u, _, vt = np.linalg.svd(np.einsum("nai,aj->nij", mobile, target))
    u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
    return u @ vt


def matched(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each frame's atoms of a group (n, g, 3) the order that fits the target's (g, 3) best; all orders are tried up to 5 atoms."""
    cost = ((x[:, None, :, :] - target[None, :, None, :]) ** 2).sum(axis=3)
    g = len(target)
    if g > 5:
        return np.array([linalg.assignment(c) for c in cost])
    orders = np.array(list(permutations(range(g))))
    total = cost[:, np.arange(g)[None, :], orders].sum(axis=2)
    return orders[total.argmin(axis=1)]


def permuted_rmsd(frames: DataFrame, target: np.ndarray, keys: list[str], align: list[int], groups: list[list[int]] | None = None, measure: list[int] | None = None) -> DataFrame:
    """``keys, features`` with one value: RMSD after superposing ``align``, with the atoms of each group matched to the target's by the
    cheapest assignment (the group is then superposed again with the others), measured over ``measure`` (default: all aligned and grouped)."""
    n = len(target)
    groups = groups or []
    over = measure if measure is not None else sorted({*align, *(a for g in groups for a in g)})

    def turned(x: np.ndarray, on: list[int]) -> np.ndarray:
        c, goal = x[:, on].mean(axis=1, keepdims=True), target[on].mean(axis=0)
        return (x - c) @ rotations(x[:, on] - c, target[on] - goal) + goal

    def build(x: np.ndarray) -> np.ndarray:
        y = turned(x, align)
        for g in groups:
            order = np.array(g)[matched(y[:, g], target[g])]
            y[:, g] = np.take_along_axis(y, order[:, :, None], axis=1)
        if groups:
            y = turned(y, sorted({*align, *(a for g in groups for a in g)}))
        return np.sqrt(((y[:, over] - target[over]) ** 2).sum(axis=2).mean(axis=1))[:, None]

    return _per_frame(frames, keys, n, "features", build)


def moments_frame(x: np.ndarray, masses: np.ndarray) -> np.ndarray:
    """A frame turned into its principal axes of inertia (mass weighted)."""
    y = x - (x * masses[:, None]).sum(axis=0) / masses.sum()
    r2 = (y * y).sum(axis=1)
    inertia = np.eye(3) * (masses * r2).sum() - (y * masses[:, None]).T @ y
    axes = np.linalg.eigh(inertia)[1]
    axes[:, 2] *= np.sign(np.linalg.det(axes))
    return y @ axes


def euler(a: float, b: float, c: float) -> np.ndarray:
    """Rotation by a about z, b about x, c about z."""

    def z(t: float) -> np.ndarray:
        return np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])

    x = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    return z(a) @ x @ z(c)


def density_overlap(x: np.ndarray, y: np.ndarray, kinds: list[str], width: float = 0.1) -> float:
    """Overlap of Gaussian densities at atoms of one kind."""
    d2 = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    same = np.array(kinds)[:, None] == np.array(kinds)[None, :]
    return float((np.exp(-d2 / (2 * width * width)) * same).sum())


def align_to_density(x: np.ndarray, y: np.ndarray, kinds: list[str], mesh: int = 4) -> np.ndarray:
    """``x`` turned for the largest density overlap with ``y``: a grid of Euler angles, then a simplex search from the best."""
    grid = [(a, b, c) for a in np.linspace(0, 2 * np.pi, mesh, endpoint=False) for b in np.linspace(0, np.pi, mesh) for c in np.linspace(0, 2 * np.pi, mesh, endpoint=False)]
    best = max(grid, key=lambda t: density_overlap(x @ euler(*t), y, kinds))
    t, _ = linalg.simplex(lambda t: -density_overlap(x @ euler(*t), y, kinds), np.array(best), 200)
    return x @ euler(*t)


def surface_areas(frames: DataFrame, names: list[str], keys: list[str], points: int = 96) -> DataFrame:
    """``keys, area``: solvent-accessible area of each atom (nm^2) by points on its sphere that lie in no other atom's sphere."""
    n = len(names)
    r = np.array([RADII[element(a)] + PROBE for a in names])
    k = np.arange(points) + 0.5
    phi, theta = np.arccos(1 - 2 * k / points), np.pi * (1 + 5**0.5) * k
    unit = np.stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)], axis=1)

    def build(x: np.ndarray) -> np.ndarray:
        free = np.empty((len(x), n))
        some = max(1, 4_000_000 // (points * n * n))
        for s in range(0, len(x), some):
            f = x[s : s + some]
            for a in range(n):  # a point of a's sphere is covered where it lies within another atom's sphere
                others = np.arange(n) != a
                apart = f[:, others] - f[:, [a]]
                reach = (apart * apart).sum(axis=2) + r[a] * r[a] - (r * r)[others]
                covered = 2 * r[a] * np.einsum("mbk,pk->mpb", apart, unit) > reach[:, None, :]
                free[s : s + some, a] = (~covered.any(axis=2)).mean(axis=1)
        return free * 4 * np.pi * r * r

    return _per_frame(frames, keys, n, "area", build)


def network(tprob: DataFrame, populations: DataFrame, pop_cutoff: float = 0.01, edge_cutoff: float = 0.1, scale: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(nodes ``i, population, energy``, edges ``i, j, weight``): states above a population, edges scaled by the largest and above a cutoff."""
    nodes = populations.where(F.col("v") > pop_cutoff).select("i", F.col("v").alias("population"), (-F.ln("v")).alias("energy"))
    kept = tprob.where("i <> j").join(F.broadcast(nodes.select("i")), "i", "left_semi").join(F.broadcast(nodes.select(F.col("i").alias("j"))), "j", "left_semi")
    top = kept.agg(F.max("p").alias("_m"))
    edges = kept.crossJoin(F.broadcast(top)).withColumn("weight", scale * F.col("p") / F.col("_m")).where(F.col("weight") > edge_cutoff).select("i", "j", "weight")
    return nodes, edges


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ord, line`` of a DOT graph."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "ord int, line string")
    a = nodes.select(F.lit(1).alias("ord"), F.format_string("  %d [label=\"%d: %.2f\"];", "i", "i", "energy").alias("line"))
    b = edges.select(F.lit(2).alias("ord"), F.format_string("  %d -> %d [penwidth=%.3f];", "i", "j", "weight").alias("line"))
    return ends.unionByName(a).unionByName(b)


def save_structures(samples: DataFrame, path: str, style: str = "sep") -> None:
    """Sampled frames (``state, draw, xyz``) as parquet: ``sep`` one folder per state and draw, ``tps`` per state, ``one`` a single table."""
    keys = {"sep": ["state", "draw"], "tps": ["state"], "one": []}[style]
    samples.write.mode("errorifexists").partitionBy(*keys).parquet(path)


def uneven_zip(columns: list[DataFrame]) -> DataFrame:
    """Tables ``i, v`` side by side by position; shorter ones repeat their last value."""
    out = None
    for k, t in enumerate(columns):
        t = t.select("i", F.col("v").alias(f"v{k}"))
        out = t if out is None else out.join(t, "i", "full")
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("i", *[F.last(f"v{k}", True).over(w).alias(f"v{k}") for k in range(len(columns))])
