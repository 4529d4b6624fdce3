"""The most similar conformations of every conformation, by collision-counting hashing (problem 5)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.functions import framecodec
from statewise.llm import space as sp
from statewise.llm.conformations import plausible
from statewise.session import materialize, sized

RADIUS, K = 0.025, 3
#: Overlap of parts and cells (see ``space.OVERLAP``).
OVERLAP = 1.8
#: Lines of the index (at most 15), and how many of them a candidate may fail to collide on.
LINES, MISS = 15, 3
#: Half width of a window at the full radius, in standard deviations of one coordinate of a difference of that length.
WINDOW = 2.5
#: The ladder of virtual rehashing: windows grow by these shares of the full width, a query stops when k verified vectors lie within the share of the radius.
LADDER = (0.5, 1.0)


#: Rows of one block of sorted arrays, queries that are looked up at once, and steps of a window's half width in which places are kept.
WIDEST, AT_ONCE, STEPS = 2048, 1024, 16
#: Rows up to which a cell's sorted arrays are kept from one step of the ladder to the next.
KEPT = 16_384


class Lines:
    """One sorted array of projections per line over some rows, and for places in it the set of the rows before that place.

    Places are kept for every border of a step (a STEPS-th of the full half width), found once by binary search. A window around a query runs
    from one border to another; the rows inside it are the difference of the two borders' sets. Sets are bit rows, and collisions are
    counted for all rows of a set at once, in four bit planes.
    """

    def __init__(self, ticks: np.ndarray):
        self.rows, lines = ticks.shape
        order = np.argsort(ticks, axis=0, kind="stable")
        ranked = np.take_along_axis(ticks, order, axis=0)
        self.low = int(ranked[0].min())
        borders = np.arange(self.low, int(ranked[-1].max()) + 2)
        self.top = len(borders) - 1
        sets = np.zeros((self.rows + 1, -(-self.rows // 64)), np.uint64)
        self.before = np.empty((lines, len(borders), sets.shape[1]), np.uint64)
        place = np.arange(1, self.rows + 1)
        for k in range(lines):
            row = order[:, k]
            sets[:] = 0
            sets[place, row >> 6] = np.uint64(1) << (row & 63).astype(np.uint64)
            np.bitwise_or.accumulate(sets, axis=0, out=sets)
            np.take(sets, np.searchsorted(ranked[:, k], borders), axis=0, out=self.before[k])

    def window(self, k: int, at: np.ndarray, width: int) -> np.ndarray:
        """Bit rows: for each projection in ``at`` the rows whose projection on line ``k`` lies within ``width`` steps of it."""
        high, low = at + (width + 1 - self.low), at - (width + self.low)
        for place in (high, low):
            np.maximum(place, 0, out=place)
            np.minimum(place, self.top, out=place)
        inside = np.take(self.before[k], high, axis=0)
        inside ^= np.take(self.before[k], low, axis=0)
        return inside

    def colliding(self, ticks: np.ndarray, width: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) with at least ``need`` collisions in windows of ``width`` steps to each side of the projections ``ticks`` of the queries."""
        planes: list[list[np.ndarray]] = [[self.window(k, ticks[:, k], width) for k in range(ticks.shape[1])], [], [], []]
        for b in range(4):  # three sets of one weight become one of that weight and one of the next
            held = planes[b]
            while len(held) > 1:
                x, y = held.pop(), held.pop()
                carry = x & y
                x ^= y
                if held:
                    z = held.pop()
                    carry |= x & z
                    x ^= z
                held.append(x)
                if b < 3:
                    planes[b + 1].append(carry)
        zero = np.zeros_like(planes[0][0])
        above, equal = zero, ~zero  # count >= need, from the highest plane down
        for b in (3, 2, 1, 0):
            bits = planes[b][0] if planes[b] else zero
            if need >> b & 1:
                equal = equal & bits
            else:
                above = above | (equal & bits)
                equal = equal & ~bits
        held_bits = (above | equal).ravel()
        word = np.flatnonzero(held_bits)
        at, bit = np.divmod(np.flatnonzero(np.unpackbits(held_bits[word].view(np.uint8), bitorder="little")), 64)
        q, w = np.divmod(word[at], zero.shape[1])
        row = w * 64 + bit
        real = row < self.rows
        return q[real], row[real]


#: Distances are compared in steps of this size.
GRAIN = 1e-10


def _best(q: np.ndarray, r: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (query, neighbour, distance) the k nearest of each query, nearest first, ties by the smaller neighbour, each neighbour once."""
    grains = np.rint(d / GRAIN).astype(np.int64)
    rows = int(max(q.max(), r.max())).bit_length() if len(q) else 0
    far = int(grains.max()).bit_length() if len(q) else 0
    if 2 * rows + far <= 63:  # all three in one integer
        code = np.sort((q.astype(np.int64) << (far + rows)) | (grains << rows) | r.astype(np.int64))
        code = code[np.r_[True, code[1:] != code[:-1]][: len(code)]]
        q, r, grains = code >> (far + rows), code & ((1 << rows) - 1), (code >> rows) & ((1 << far) - 1)
    else:
        order = np.lexsort((r, grains, q))
        q, r, grains = q[order], r[order], grains[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])][: len(q)]
        q, r, grains = q[fresh], r[fresh], grains[fresh]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    top = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
    return q[top], r[top], np.round(grains[top] * GRAIN, 10)


def apart(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, in pieces."""
    out = np.empty(len(i))
    for s in range(0, len(i), 8192):
        d = v[i[s : s + 8192]] - v[j[s : s + 8192]]
        out[s : s + 8192] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def nearest(v: np.ndarray, cut: np.ndarray, h: np.ndarray, overlap: float, radius: float, k: int) -> tuple[np.ndarray, ...]:
    """(query row, neighbour row, distance) of up to ``k`` verified neighbours within ``radius`` of every row, nearest first, ties by the smaller row.

    Virtual rehashing in every cell: the rows that collide with a query in the narrowest windows are verified first; a query with k neighbours
    within that step's share of the radius is done, the windows of the others are widened (as is the window of distances from the origin). Candidates are verified block by block,
    so memory does not grow with the number of pairs.
    """
    window = WINDOW * radius / np.sqrt(max(1, v.shape[1] - 3))
    need = max(1, h.shape[1] - MISS)
    ticks = np.clip(np.rint(h * (STEPS / window)), -30_000, 30_000).astype(np.int32)
    n = len(v)
    far = np.linalg.norm(v, axis=1)
    none = np.empty(0, np.int64)
    best = (none, none, np.empty(0))
    fresh: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        nonlocal best
        i, j, d = (np.concatenate(x) for x in zip(*fresh, strict=True))
        best = _best(np.concatenate([best[0], i, j]), np.concatenate([best[1], j, i]), np.concatenate([best[2], d, d]), k)
        fresh.clear()

    for at in sp.cells(cut, overlap):
        at = at[np.argsort(far[at], kind="stable")]
        blocks = [at[s : s + WIDEST] for s in range(0, len(at), WIDEST)]
        index = [Lines(ticks[b]) for b in blocks] if len(at) <= KEPT else None
        done = np.zeros(len(at), bool)
        for share in LADDER:
            reach = share * radius * (1 + 1e-6) + 1e-9
            near = np.zeros(len(at), np.int64)
            for k_, block in enumerate(blocks):
                low, high = np.searchsorted(far[at], [far[block[0]] - reach, far[block[-1]] + reach])
                asked = low + np.flatnonzero(~done[low:high])
                lines = index[k_] if index is not None else Lines(ticks[block])
                for c in range(0, len(asked), AT_ONCE):
                    some = asked[c : c + AT_ONCE]
                    i, j = lines.colliding(ticks[at[some]], round(share * STEPS), need)
                    i, j = some[i], k_ * WIDEST + j
                    once = (i < j) | (done[j] & (i > j))  # two open rows ask each other: one of them is enough
                    i, j = i[once], j[once]
                    p, q = at[i], at[j]
                    d = apart(v, p, q)
                    good = d <= radius * (1 + 1e-9)
                    fresh.append((p[good], q[good], d[good]))
                    close = d <= share * radius
                    near += np.bincount(np.concatenate([i[close], j[close]]), minlength=len(at))
            done |= near >= k
        if sum(len(d) for *_, d in fresh) > 1_000_000:
            merge()
    if fresh:
        merge()
    return best


def thin_copies(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to search (of exact copies the k + 1 smallest ids), and for each further copy its row and the first row of its content."""
    code = np.empty(len(v), np.int64)
    odd = np.random.default_rng(5).integers(1, 2**62, v.shape[1], dtype=np.int64) | 1
    for s in range(0, len(v), 8192):  # exact copies have one code; only codes of many rows are compared in full
        bits = np.ascontiguousarray(v[s : s + 8192]).view(np.int64)
        with np.errstate(over="ignore"):
            code[s : s + 8192] = (bits ^ (bits >> 29)) @ odd
    _, group, size = np.unique(code, return_inverse=True, return_counts=True)
    none = np.empty(0, np.int64)
    some = np.flatnonzero(size[group] > k + 1)
    if not len(some):
        return np.arange(len(ids)), none, none
    code = np.ascontiguousarray(v[some]).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, group, size = np.unique(code, return_inverse=True, return_counts=True)
    order = np.lexsort((ids[some], group))
    start = np.cumsum(np.r_[0, size[:-1]])
    place = np.arange(len(order)) - start[group[order]]
    extra = place > k
    further, first = some[order[extra]], some[order[start[group[order[extra]]]]]
    return np.setdiff1d(np.arange(len(ids)), further), further, first


def lines_of(width: int) -> np.ndarray:
    """LINES orthonormal random directions, other than those of the cuts."""
    return sp.random_axes(width, LINES, 41)


def local_neighbours(table: DataFrame, space: sp.Forest, n_atoms: int, radius: float, k: int) -> DataFrame:
    """``frame_id, other, d``: up to k neighbours of each frame in each part; ``d`` null where ``other`` is the representative of a further copy."""
    part_of = {key: part for part, key in enumerate(sp.part_keys(table.sparkSession, space.parts))}

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sp.gathered(batches, n_atoms, space)
        if got is None:
            return
        key, fid, v, extra, rep = got
        tree = space.tree_of(part_of[key])
        rows, more, first = thin_copies(fid, v, k)
        more, first, ids = fid[more], fid[first], fid[rows]
        for c in range(0, len(rows), 8192):  # in place: the rows are in order
            v[c : c + len(rows[c : c + 8192])] = v[rows[c : c + 8192]]
        w = v[: len(rows)]
        q, r, d = nearest(w, (w @ tree.axes).astype(np.float32), (w @ lines_of(w.shape[1])).astype(np.float32), tree.overlap, radius, k)
        a, b = np.concatenate([ids[q], extra, more]), np.concatenate([ids[r], rep, first])
        d = pa.array(np.concatenate([d, np.full(len(a) - len(d), np.nan)]), from_pandas=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), d], ["frame_id", "other", "d"])

    return sp.spread(table, space, n_atoms, k + 1).mapInArrow(search, "frame_id long, other long, d double")


def neighbours(table: DataFrame, n_atoms: int = 22, radius: float = RADIUS, k: int = K, part: int = sp.PART, overlap: float = OVERLAP) -> DataFrame:
    """``frame_id, other, d``: for every frame its ``k`` nearest other frames within ``radius`` (fewer if fewer lie there), ties by smaller id.

    Every frame is a query against all frames. ``table`` has ``frame_id, vec`` (packed frames); the same id twice counts once, exact copies
    are neighbours at distance 0. The index is one sorted array per line inside overlapping parts and cells; the loss against brute force is
    measured in the tests and stated in the README. ``nearest_frames`` has no radius. An empty table gives no rows.
    """
    n = table.count()
    space = sp.space_of(table, n, n_atoms, radius, part, overlap)
    local = materialize(local_neighbours(table, space, n_atoms, radius, k))
    best = local.where("d is not null").groupBy("frame_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "other"))), 1, k).alias("_n"))
    copies = local.where("d is null").select("frame_id", F.col("other").alias("_rep"))
    if copies.limit(1).count():
        copies = materialize(copies)
        again = materialize(copies.join(sized(materialize(copies.select("_rep").distinct().withColumnRenamed("_rep", "frame_id"))), "frame_id", "left_semi").select(F.col("frame_id").alias("_rep"), F.col("_rep").alias("_first")))
        copies = copies.join(sized(again), "_rep", "left").select("frame_id", F.coalesce("_first", "_rep").alias("_rep"))
        reps = sized(materialize(copies.select(F.col("_rep").alias("frame_id")).distinct()))
        of_rep = materialize(best.join(reps, "frame_id", "left_semi").select(F.col("frame_id").alias("_rep"), "_n"))
        own = F.slice(F.sort_array(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), F.col("_rep").alias("other"))), F.filter("_n", lambda x: x["d"] == 0))), 1, k)
        best = best.unionByName(copies.join(sized(of_rep), "_rep").select("frame_id", own.alias("_n")))
    return best.select("frame_id", F.explode("_n").alias("_x")).select("frame_id", F.col("_x.other").alias("other"), F.col("_x.d").alias("d"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``frame_id_a, frame_id_b``, smaller id first, each pair once."""
    return found.select(F.least("frame_id", "other").alias("frame_id_a"), F.greatest("frame_id", "other").alias("frame_id_b")).distinct()


def found(frames: DataFrame) -> DataFrame:
    return neighbour_pairs(neighbours(plausible(frames)))


#: Queries of one block (one broadcast, one pass over the frames), and every how many ids one is a query.
QUERIES, EVERY = 16_384, 50


def nearest_frames(frames: DataFrame, k: int = K, every: int = EVERY, n_atoms: int = 22, queries: int = QUERIES) -> DataFrame:
    """``frame_id, other, d``: the ``k`` nearest other frames, at any distance, of every frame whose id is divisible by ``every``; ties by smaller id.

    The queries are taken in blocks of ``queries``; each block meets all frames in one pass over their Arrow batches, in which the ladder has no
    last step: the distance that k frames lie within is the window of what follows. Blocks are exact; their number grows with the frames.
    Frames that are null, short or faulty are neither queries nor neighbours, the same id twice counts once; an empty table has no rows.
    """
    table = materialize(plausible(frames, n_atoms))
    asked = materialize(table.where(F.col("frame_id") % every == 0).dropDuplicates(["frame_id"]))
    n = asked.count()
    blocks = max(1, -(-n // queries))
    sc = frames.sparkSession.sparkContext
    parts, shared = [], []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("frame_id"), F.lit(blocks)) == block).orderBy("frame_id").toArrow()
        ids = some["frame_id"].to_numpy()
        q = vectors_of(some["vec"].combine_chunks(), n_atoms) if len(ids) else np.empty((0, 3 * n_atoms))
        shared.append(sc.broadcast((ids, q)))

        def search(batches: Iterable[pa.RecordBatch], shared=shared[-1]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            reach = np.full(len(ids), np.inf)
            square = (q * q).sum(axis=1)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                fid = batch.column("frame_id").to_numpy()
                v = vectors_of(batch.column("vec"), n_atoms)
                own = (v * v).sum(axis=1)
                i, j, d = [], [], []
                for s in range(0, len(ids), 2048):
                    d2 = square[s : s + 2048, None] + own[None, :] - 2 * (q[s : s + 2048] @ v.T)
                    limit = reach[s : s + 2048] ** 2
                    if d2.shape[1] > 3 * k and np.isinf(limit).any():  # room for the query itself and for a frame delivered twice
                        limit = np.minimum(limit, np.partition(d2, 3 * k, axis=1)[:, 3 * k])
                    a, b = np.nonzero(d2 <= (limit + 1e-9)[:, None])
                    a = a + s
                    other = fid[b] != ids[a]
                    i.append(a[other])
                    j.append(b[other])
                    d.append(np.round(np.sqrt(((q[i[-1]] - v[j[-1]]) ** 2).sum(axis=1)), 10))
                a, b, d = np.concatenate(i), fid[np.concatenate(j)], np.concatenate(d)
                best = _best(np.concatenate([best[0], a]), np.concatenate([best[1], b]), np.concatenate([best[2], d]), k)
                count = np.bincount(best[0], minlength=len(ids))
                last = np.cumsum(count) - 1
                full = count >= k
                reach[full] = best[2][last[full]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["frame_id", "other", "d"])

        parts.append(table.mapInArrow(search, "frame_id long, other long, d double"))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    top = got.groupBy("frame_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "other"))), 1, k).alias("_n"))
    out = materialize(top.select("frame_id", F.explode("_n").alias("_x")).select("frame_id", F.col("_x.other").alias("other"), F.col("_x.d").alias("d")))
    for b in shared:
        b.destroy()
    return out


def vectors_of(column: pa.Array, n_atoms: int) -> np.ndarray:
    return sp.vectors(framecodec.unpack(column, n_atoms))
