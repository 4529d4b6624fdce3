"""Vectors of frames, their partition into overlapping parts and cells (or into bands, the exact way), and the blocks in which they travel."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.functions import framecodec
from statewise.functions.arrowgroups import groups

#: Vectors from which cuts are fitted: at least this many, and LEAF per part up to MOST_SAMPLE (16 single-precision coordinates each, 64 bytes).
SAMPLE, LEAF, MOST_SAMPLE = 20_000, 128, 1_000_000
#: Reduced dimensions kept for cutting, vectors aimed at per shuffled part (overlap included), and per cell inside a part.
DIMS, PART, CELL = 16, 160_000, 4096
#: Overlap of two neighbouring parts or cells, in standard deviations of one coordinate of a difference of length ``radius``.
OVERLAP = 2.0
#: Axes on which pairs of vectors are compared before their full distance is.
FILTER = 20
#: Seed of the axes of the first tree; the next tree has the next seed.
SEED = 23
#: Vectors gathered before they are sent on in one block per part.
FLUSH = 65_536


def random_axes(width: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` orthonormal random directions (fewer if the vectors have fewer coordinates)."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(count, width))))[0]


@dataclass
class Space:
    """Axes, the overlap, a tree of cuts (``axis``, ``value`` per node; node k has the children 2k + 1 and 2k + 2), and the cuts below it."""

    origin: np.ndarray
    axes: np.ndarray
    overlap: float
    axis: np.ndarray
    value: np.ndarray
    depth: int
    deeper: list[tuple[int, float]]
    radius: float

    @property
    def parts(self) -> int:
        return 2 ** (self.depth + len(self.deeper))

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) pairs: every row goes to each part whose border it is within half the overlap of."""
        z = (v - self.origin) @ self.axes
        row, node = np.arange(len(z)), np.zeros(len(z), np.int64)

        def split(side: np.ndarray) -> None:
            nonlocal row, node
            low, high = side <= self.overlap / 2, side > -self.overlap / 2
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])

        for _ in range(self.depth):
            split(z[row, self.axis[node]] - self.value[node])
        for axis, value in self.deeper:
            split(z[row, axis] - value)
        return row, node - (self.parts - 1)


@dataclass
class Forest:
    """Several Spaces with axes of their own: every vector goes to parts of each, so a pair is parted only if every tree parts it."""

    trees: list[Space]

    @property
    def origin(self) -> np.ndarray:
        return self.trees[0].origin

    @property
    def parts(self) -> int:
        return sum(t.parts for t in self.trees)

    def tree_of(self, part: int) -> Space:
        for t in self.trees:
            if part < t.parts:
                return t
            part -= t.parts
        raise ValueError(part)

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        routed, first = [], 0
        for t in self.trees:
            row, part = t.route(v)
            routed.append((row, part + first))
            first += t.parts
        return np.concatenate([r for r, _ in routed]), np.concatenate([p for _, p in routed])


@dataclass
class Bands:
    """Bands of distance from an origin (``edges`` between them) and the pairs of bands in which two vectors within ``radius`` can lie:
    every such pair of vectors meets in one of them (two vectors within the radius are as far from any origin, up to the radius)."""

    origin: np.ndarray
    axes: np.ndarray
    edges: np.ndarray
    radius: float

    @property
    def pairs(self) -> list[tuple[int, int]]:
        reach = self.radius * (1 + 1e-6) + 1e-9
        low, high = np.r_[-np.inf, self.edges], np.r_[self.edges, np.inf]
        return [(a, b) for a in range(len(low)) for b in range(a, len(low)) if low[b] - high[a] <= reach]

    @property
    def parts(self) -> int:
        return len(self.pairs)

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) pairs: a row goes to the pairs of its band with every band that it lies within the radius of."""
        far = np.linalg.norm(v - self.origin, axis=1)
        band = np.searchsorted(self.edges, far)
        reach = self.radius * (1 + 1e-6) + 1e-9
        low, high = np.r_[-np.inf, self.edges], np.r_[self.edges, np.inf]
        rows, parts = [], []
        for k, (a, b) in enumerate(self.pairs):
            at = np.flatnonzero(((band == a) & (far >= low[b] - reach)) | ((band == b) & (far <= high[a] + reach)))
            rows.append(at)
            parts.append(np.full(len(at), k))
        return np.concatenate(rows), np.concatenate(parts)


def bands(sample: np.ndarray, n: int, radius: float, part: int = PART) -> Bands:
    """Bands of about ``part`` of ``n`` vectors, and FILTER random orthonormal axes."""
    v = np.asarray(sample, np.float64)
    if not len(v):
        v = np.zeros((1, 3))
    origin = np.median(v, axis=0)
    count = min(-(-n // part), len(v))
    edges = np.unique(np.quantile(np.linalg.norm(v - origin, axis=1), np.arange(1, count) / count)) if count > 1 else np.empty(0)
    return Bands(origin, random_axes(v.shape[1], FILTER), edges, radius)


def vectors(x: np.ndarray) -> np.ndarray:
    """(n, atoms, 3) to centred (n, 3 atoms) scaled so that the Euclidean distance is the root of the mean squared displacement."""
    return ((x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.shape[1])).reshape(len(x), -1)


def overlap_of(width: int, radius: float, overlap: float = OVERLAP) -> float:
    return overlap * radius / np.sqrt(max(1, width - 3))


def _cut(z: np.ndarray, overlap: float) -> tuple[int, float]:
    """The axis whose median cut doubles the fewest points."""
    middle = np.median(z, axis=0)
    axis = int(np.argmin((np.abs(z - middle) <= overlap / 2).sum(axis=0)))
    return axis, float(middle[axis])


def fit(z: np.ndarray, origin: np.ndarray, n: int, radius: float, part: int = PART, overlap: float = OVERLAP, seed: int = SEED) -> Space:
    """Cuts for ``n`` vectors in parts of about ``part`` (copies in overlaps included), at medians of the reduced sample ``z`` (taken from
    ``origin`` along the ``random_axes`` of ``seed``).

    The axes are a seeded random orthonormal set, not principal axes: whatever direction two vectors differ in, its share along a random
    axis is as likely as any other's, so a difference of length ``radius`` exceeds the overlap (OVERLAP standard deviations of one
    coordinate) only with the tail of a normal law, and only such a pair can be parted by a cut between its two places. Along principal
    axes differences may gather in the first one. The depth grows with ``n``: while 64 sampled vectors fall on a node its own cut is
    fitted, below that whole levels are cut at the sample's median of one axis after another.
    """
    width = len(origin)
    apart = overlap_of(width, radius, overlap)
    axes = random_axes(width, DIMS, seed)
    if not len(z):
        z = np.zeros((1, axes.shape[1]))
    axis, value, leaves, depth = [], [], [np.arange(len(z))], 0
    while n * max(map(len, leaves)) / len(z) > part and max(map(len, leaves)) >= 128:
        grown = []
        for rows in leaves:
            a, at = _cut(z[rows], apart) if len(rows) else (depth % z.shape[1], 0.0)
            axis.append(a)
            value.append(at)
            side = z[rows, a] - at
            grown += [rows[side <= apart / 2], rows[side > -apart / 2]]
        before, leaves, depth = max(map(len, leaves)), grown, depth + 1
        if max(map(len, leaves)) > 0.95 * before:
            break
    size = n * np.mean([len(rows) for rows in leaves]) / len(z)
    middle = np.median(z, axis=0)
    doubled = (np.abs(z - middle) <= apart / 2).mean(axis=0)
    deeper: list[tuple[int, float]] = []
    for a in np.argsort(doubled, kind="stable").tolist() if size > part else []:
        if size <= part or doubled[a] > 0.8:
            break
        deeper.append((a, float(middle[a])))
        size *= (1 + doubled[a]) / 2
    return Space(origin, axes, apart, np.array(axis, np.int64), np.array(value), depth, deeper, radius)


def cells(z: np.ndarray, overlap: float, size: int | None = None) -> Iterator[np.ndarray]:
    """Overlapping sets of rows, of about ``size`` where cuts still separate them: rows closer than ``overlap`` on every axis share a set."""
    stack = [np.arange(len(z))]
    size = size or CELL
    while stack:
        at = stack.pop()
        if len(at) <= size:
            if len(at) > 1:
                yield at
            continue
        step = max(1, len(at) // 192)
        axis, value = _cut(z[at[::step]], overlap)
        side = z[at, axis] - value
        low, high = at[side <= overlap / 2], at[side > -overlap / 2]
        if max(len(low), len(high)) > 0.95 * len(at):
            yield at
            continue
        stack += [low, high]


def part_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that Spark's hash partitioning sends to ``n`` different partitions."""
    found: dict[int, int] = {}
    span = 64 * n
    start = 0
    while len(found) < n:
        for k, p in spark.range(start, start + span).select("id", F.expr(f"pmod(hash(cast(id as int)), {n})")).toLocalIterator():
            found.setdefault(p, k)
        start += span
    return [found[p] for p in range(n)]


def _share(table: DataFrame, n: int, most: int) -> DataFrame:
    step = max(1, n // most)
    return table.where(F.pmod(F.xxhash64("frame_id", F.lit(17)), F.lit(step)) == 0).limit(2 * most)


def sample_vectors(table: DataFrame, n: int, n_atoms: int) -> np.ndarray:
    """Packed frames whose hashed id falls into a share of SAMPLE / n, as vectors."""
    rows = _share(table, n, SAMPLE).select("vec").toArrow()
    return vectors(framecodec.unpack(rows["vec"].combine_chunks(), n_atoms)) if rows.num_rows else np.zeros((0, 3 * n_atoms))


def reduced_sample(table: DataFrame, n: int, n_atoms: int, origin: np.ndarray, most: int, seed: int = SEED) -> np.ndarray:
    """The reduced vectors of a hashed share of ``most`` of ``n`` frames, projected where they lie; single precision."""
    axes = random_axes(3 * n_atoms, DIMS, seed)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = ((vectors(framecodec.unpack(batch.column("vec"), n_atoms)) - origin) @ axes).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()])], ["z"])

    got = _share(table, n, most).select("vec").mapInArrow(project, "z binary").toArrow()["z"].to_pylist()
    return np.frombuffer(b"".join(got), "<f4").reshape(-1, axes.shape[1]).astype(np.float64)


def space_of(table: DataFrame, n: int, n_atoms: int, radius: float, part: int = PART, overlap: float = OVERLAP, trees: int = 1) -> Forest:
    """The Forest of ``n`` packed frames; the sample grows with the parts (LEAF a part) up to MOST_SAMPLE."""
    first = sample_vectors(table, n, n_atoms)
    origin = np.median(first, axis=0) if len(first) else np.zeros(3 * n_atoms)
    most = min(MOST_SAMPLE, LEAF * 4 * -(-n // part))
    grown = []
    for seed in range(SEED, SEED + trees):
        z = reduced_sample(table, n, n_atoms, origin, most, seed) if most > 2 * SAMPLE else (first - origin) @ random_axes(3 * n_atoms, DIMS, seed)
        grown.append(fit(z, origin, n, radius, part, overlap, seed))
    return Forest(grown)


# Blocks: many frames of one part in one row. Ticks are taken from a base structure and from each frame's own shift, and stored as the planes of
# their low and high bytes, so that what is left is little more than the frames' noise.


def squeeze(ids: np.ndarray, ticks: np.ndarray, base: np.ndarray) -> bytes:
    """Ids and (n, 3 atoms) integer ticks as one compressed block; exact."""
    n, width = ticks.shape
    off = ticks - base
    shift = np.rint(off.reshape(n, -1, 3).mean(axis=1)).astype(np.int64)
    off = (off.reshape(n, -1, 3) - shift[:, None]).reshape(n, width)
    odd = ((off << 1) ^ (off >> 63)).astype("<u4").view(np.uint8).reshape(n, width, 4)
    top = 4 if odd[..., 2:].any() else 2
    raw = b"".join([np.int64(n).tobytes(), np.int64(top).tobytes(), ids.astype("<i8").tobytes(), shift.astype("<i4").tobytes(), *[np.ascontiguousarray(odd[..., k]).tobytes() for k in range(top)]])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expand(block: bytes, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ticks) of a block."""
    raw = pa.Codec("zstd").decompress(block[8:], int(np.frombuffer(block[:8], "<i8")[0]), asbytes=True)
    n, top = np.frombuffer(raw[:16], "<i8").tolist()
    width = len(base)
    ids = np.frombuffer(raw, "<i8", n, 16)
    shift = np.frombuffer(raw, "<i4", 3 * n, 16 + 8 * n).reshape(n, 3).astype(np.int64)
    at = 16 + 20 * n
    odd = np.zeros((n, width), np.int64)
    for k in range(top):
        odd |= np.frombuffer(raw, np.uint8, n * width, at + k * n * width).reshape(n, width).astype(np.int64) << (8 * k)
    off = (odd >> 1) ^ -(odd & 1)
    return ids, (off.reshape(n, -1, 3) + shift[:, None]).reshape(n, width) + base


def base_of(space: Forest | Bands, n_atoms: int) -> np.ndarray:
    return np.rint(space.origin * np.sqrt(n_atoms) * framecodec.SCALE).astype(np.int64)


#: Kinds of blocks: squeezed frames, frames as doubles, surplus copies as (id, rep).
FRAMES, DOUBLES, COPIES = 0, 1, 2


def spread(table: DataFrame, space: Forest | Bands, n_atoms: int, copies: int) -> DataFrame:
    """``part, kind, block``: packed frames of ``table`` (``frame_id, vec``) shuffled in blocks to the parts of ``space``.

    Of exact copies among the frames gathered for a block only the ``copies`` smallest ids travel as vectors; of each further copy only the
    id and the smallest id (its rep) travel, dealt out evenly, so a content that fills a third of all rows does not fill one part.
    """
    spark = table.sparkSession
    parts = space.parts
    keys = np.array(part_keys(spark, parts), np.int32)
    base = base_of(space, n_atoms)

    def blocks(fid: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        rng = np.random.default_rng(5).integers(1, 2**62, 12 * n_atoms, dtype=np.int64) | 1
        bits = x.reshape(len(x), -1).view(np.int64)
        with np.errstate(over="ignore"):
            code = (bits ^ (bits >> 29)) @ rng[: bits.shape[1]]
        order = np.lexsort((fid, code))
        again = np.r_[False, (np.diff(code[order]) == 0) & (np.diff(fid[order]) == 0)]
        order = order[~again]
        start = np.r_[True, np.diff(code[order]) != 0]
        group = np.cumsum(start) - 1
        place = np.arange(len(order)) - np.flatnonzero(start)[group]
        first = order[np.flatnonzero(start)[group]]
        late = np.flatnonzero(place >= copies)
        extra = np.zeros(len(order), bool)
        extra[late] = (bits[order[late]] == bits[first[late]]).all(axis=1)
        keep, surplus = order[~extra], order[extra]
        row, part = space.route(vectors(x[keep]))
        flat = x[keep].reshape(len(keep), -1)
        ticks = np.rint(flat * framecodec.SCALE)
        exact = ((np.abs(ticks) < 1e8) & (ticks / framecodec.SCALE == flat)).all(axis=1)
        by = np.argsort(part, kind="stable")
        row, part = row[by], part[by]
        edges = np.flatnonzero(np.r_[True, np.diff(part) != 0, True]) if len(part) else np.zeros(0, int)
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            some = row[a:z]
            some = some[np.argsort(fid[keep[some]], kind="stable")]
            short, long = some[exact[some]], some[~exact[some]]
            if len(short):
                yield int(part[a]), FRAMES, squeeze(fid[keep[short]], ticks[short].astype(np.int64), base)
            if len(long):
                yield int(part[a]), DOUBLES, fid[keep[long]].astype("<i8").tobytes() + flat[long].astype("<f8").tobytes()
        if len(surplus):
            rep = fid[first[extra]]
            for s in range(0, len(surplus), 4096):
                yield int((fid[0] + s // 4096) % parts), COPIES, fid[surplus[s : s + 4096]].astype("<i8").tobytes() + rep[s : s + 4096].astype("<i8").tobytes()

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for part, kind, block in blocks(np.concatenate([f for f, _ in held]), np.concatenate([x for _, x in held])):
                yield pa.RecordBatch.from_arrays([pa.array(keys[[part]]), pa.array([kind], pa.int32()), pa.array([block], pa.binary())], ["part", "kind", "block"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("frame_id").to_numpy(), framecodec.unpack(batch.column("vec"), n_atoms)))
                if sum(len(f) for f, _ in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return table.select("frame_id", "vec").mapInArrow(mapped, "part int, kind int, block binary").repartition(parts, "part")


def gathered(batches: Iterable[pa.RecordBatch], n_atoms: int, space: Forest | Bands) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of one shuffled part: its key, ids, vectors (from the origin, each id once, in id order), and the surplus copies as ids and reps."""
    base, width = base_of(space, n_atoms), 3 * n_atoms
    key = None
    none = np.empty(0, np.int64)
    ids, vs, extra, reps = [none], [np.empty((0, width))], [none], [none]
    for batch in batches:
        for part, kind, block in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True):
            key = part
            if kind == COPIES:
                two = np.frombuffer(block, "<i8").reshape(2, -1)
                extra.append(two[0])
                reps.append(two[1])
                continue
            if kind == FRAMES:
                fid, ticks = expand(block, base)
                x = ticks / framecodec.SCALE
            else:
                n = len(block) // (8 + 8 * width)
                fid, x = np.frombuffer(block, "<i8", n), np.frombuffer(block, "<f8", n * width, 8 * n).reshape(n, width)
            ids.append(fid)
            vs.append(vectors(x.reshape(len(x), n_atoms, 3)) - space.origin)
    if key is None:
        return None
    total = np.concatenate(ids)
    v = np.empty((len(total), width))
    at = 0
    for k, some in enumerate(vs):  # moved piece by piece: the part is held once
        v[at : at + len(some)] = some
        at += len(some)
        vs[k] = None
    fid, first = np.unique(total, return_index=True)
    if len(fid) < len(total) or (np.diff(first) < 0).any():
        v = v[first]
    return key, fid, v, np.concatenate(extra), np.concatenate(reps)


__all__ = ["CELL", "DIMS", "FILTER", "OVERLAP", "PART", "SAMPLE", "Bands", "Forest", "Space", "bands", "cells", "expand", "fit", "gathered", "groups", "overlap_of", "part_keys", "random_axes", "reduced_sample", "sample_vectors", "space_of", "spread", "squeeze", "vectors"]
