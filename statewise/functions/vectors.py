"""Distances and featurizers as column expressions over array columns; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x * y)


def _centred(a: Column) -> Column:
    mean = total(F.transform(a, lambda x: x.cast("double"))) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def _cosine(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _tally(a: Column, b: Column, x: bool, y: bool) -> Column:
    return total(F.zip_with(a, b, lambda p, q: F.when((p == F.lit(x)) & (q == F.lit(y)), 1.0).otherwise(0.0)))


def _bool(f: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    def distance(a: Column, b: Column) -> Column:
        tt, tf, ft, ff = (_tally(a, b, *k) for k in ((True, True), (True, False), (False, True), (False, False)))
        return f(tt, tf, ft, ff, F.size(a).cast("double"))

    return distance


def minkowski(p: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.pow(pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def seuclidean(variances: list[float]) -> Callable[[Column, Column], Column]:
    v = F.array(*[F.lit(float(x)) for x in variances])
    return lambda a, b: F.sqrt(total(F.zip_with(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), v, lambda d, s: d / s)))


def sqmahalanobis(inverse: list[list[float]]) -> Callable[[Column, Column], Column]:
    rows = [F.array(*[F.lit(float(x)) for x in r]) for r in inverse]

    def distance(a: Column, b: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return dot(d, F.array(*[dot(d, r) for r in rows]))

    return distance


def mahalanobis(inverse: list[list[float]]) -> Callable[[Column, Column], Column]:
    squared = sqmahalanobis(inverse)
    return lambda a, b: F.sqrt(squared(a, b))


#: Distances of two numeric arrays, and of two boolean arrays (counts of true/true, true/false, false/true, false/false, and the length).
NUMERIC: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda a, b: F.sqrt(pairwise(a, b, lambda x, y: (x - y) * (x - y))),
    "sqeuclidean": lambda a, b: pairwise(a, b, lambda x, y: (x - y) * (x - y)),
    "cityblock": lambda a, b: pairwise(a, b, lambda x, y: F.abs(x - y)),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))),
    "minkowski": minkowski(3.0),
    "cosine": _cosine,
    "correlation": lambda a, b: _cosine(_centred(a), _centred(b)),
    "braycurtis": lambda a, b: F.try_divide(pairwise(a, b, lambda x, y: F.abs(x - y)), pairwise(a, b, lambda x, y: F.abs(x + y))),
    "canberra": lambda a, b: pairwise(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))),
}
BOOLEAN: dict[str, Callable[[Column, Column], Column]] = {
    "matching": _bool(lambda tt, tf, ft, ff, n: (tf + ft) / n),
    "dice": _bool(lambda tt, tf, ft, ff, n: F.try_divide(tf + ft, 2 * tt + tf + ft)),
    "kulsinki": _bool(lambda tt, tf, ft, ff, n: F.try_divide(tf + ft - tt + n, tf + ft + n)),
    "rogerstanimoto": _bool(lambda tt, tf, ft, ff, n: F.try_divide(2 * (tf + ft), tt + ff + 2 * (tf + ft))),
    "russellrao": _bool(lambda tt, tf, ft, ff, n: (n - tt) / n),
    "sokalmichener": _bool(lambda tt, tf, ft, ff, n: F.try_divide(2 * (tf + ft), tt + ff + 2 * (tf + ft))),
    "sokalsneath": _bool(lambda tt, tf, ft, ff, n: F.try_divide(2 * (tf + ft), tt + 2 * (tf + ft))),
    "yule": _bool(lambda tt, tf, ft, ff, n: F.coalesce(F.try_divide(2 * tf * ft, tt * ff + tf * ft), F.lit(0.0))),
}

BOOLEAN["kulsinski"] = BOOLEAN["kulsinki"]

#: Metrics added by users or by installed packages: name -> function of two columns.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {**NUMERIC, **BOOLEAN}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """A registered metric; then one of the entry points ``statewise.metrics`` of installed packages; else TypeError."""
    if name not in REGISTRY:
        from importlib.metadata import entry_points

        for point in entry_points(group="statewise.metrics"):
            if point.name == name:
                REGISTRY[name] = point.load()
                break
        else:
            raise TypeError(f"no metric {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def hybrid(parts: list[tuple[Callable[[Column, Column], Column], float]], p: float | None = None) -> Callable[[list[tuple[Column, Column]]], Column]:
    """Weighted sum of distances, or with ``p`` the p-norm of the weighted distances, over pairs of feature columns."""

    def distance(pairs: list[tuple[Column, Column]]) -> Column:
        d = [w * f(a, b) for (f, w), (a, b) in zip(parts, pairs, strict=True)]
        if p is None:
            return sum(d[1:], d[0])
        powers = [F.pow(x, F.lit(p)) for x in d]
        return F.pow(sum(powers[1:], powers[0]), F.lit(1.0 / p))

    return distance


# Featurizers of one frame (array of [x, y, z]).


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance_of(xyz: Column, i: int, j: int) -> Column:
    return F.sqrt((xyz[i][0] - xyz[j][0]) ** 2 + (xyz[i][1] - xyz[j][1]) ** 2 + (xyz[i][2] - xyz[j][2]) ** 2)


def atom_pairs(xyz: Column, pairs: list[tuple[int, int]]) -> Column:
    """Distances of the listed atom pairs."""
    return F.array(*[distance_of(xyz, i, j) for i, j in pairs])


def dihedral(xyz: Column, i: int, j: int, k: int, m: int) -> Column:
    """Torsion angle of four atoms, in radians."""
    b1, b2, b3 = _minus(xyz[j], xyz[i]), _minus(xyz[k], xyz[j]), _minus(xyz[m], xyz[k])
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    return F.atan2(F.sqrt(dot(b2, b2)) * dot(b1, n2), dot(n1, n2))


def torsions(xyz: Column, quads: list[tuple[int, int, int, int]]) -> Column:
    """Cosines of all listed torsions, then their sines."""
    angles = [dihedral(xyz, *q) for q in quads]
    return F.array(*[F.cos(a) for a in angles], *[F.sin(a) for a in angles])


def contacts(xyz: Column, residues: list[list[int]], pairs: list[tuple[int, int]]) -> Column:
    """Least atom distance of each listed residue pair (residues as lists of atoms: one atom each for the alpha scheme)."""
    return F.array(*[F.least(*d) if len(d) > 1 else d[0] for d in ([distance_of(xyz, i, j) for i in residues[a] for j in residues[b]] for a, b in pairs)])


def boolean_contacts(distances: Column, cutoff: float | list[float]) -> Column:
    """Which distances are below their cutoff (one for all, or one each)."""
    if isinstance(cutoff, (int, float)):
        return F.transform(distances, lambda x: x < F.lit(float(cutoff)))
    return F.zip_with(distances, F.array(*[F.lit(float(c)) for c in cutoff]), lambda x, c: x < c)


def centre(xyz: Column) -> Column:
    """The frame moved so that the mean of its atoms is the origin."""

    def axis(k: int) -> Column:
        return total(F.transform(xyz, lambda p: p[k])) / F.size(xyz)

    mean = [axis(k) for k in range(3)]
    return F.transform(xyz, lambda p: F.array(p[0] - mean[0], p[1] - mean[1], p[2] - mean[2]))


def flat(xyz: Column) -> Column:
    return F.flatten(xyz)


def natural_key(name: Column) -> Column:
    """Sort key that reads runs of digits as numbers: runs padded to 20 places."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(r, 20, "0")).otherwise(r)), "")


def integer_component(name: Column) -> Column:
    """First run of digits of a file name as a number; 0 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), F.lit(0))
