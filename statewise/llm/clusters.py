"""Grouping conformations into clusters of mutually similar frames (problem 1)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions import framecodec
from statewise.llm import space as sp
from statewise.llm.conformations import plausible
from statewise.session import forget, materialize, sized

RADIUS = 0.025


#: Rows of a tile of the comparison, and links gathered before they are merged.
TILE, LINKS = 1024, 500_000


class Merged:
    """Components of rows that are linked one batch after another; links within a component are forgotten at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._open: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        new = a != b
        if new.any():
            self._open.append((a[new], b[new]))
            self._held += int(new.sum())
            if self._held > LINKS:
                self.settle()

    def settled(self, least: int) -> np.ndarray:
        """The labels, after merging what is open if that is at least ``least`` links."""
        return self.settle() if self._held >= least else self.label

    def settle(self) -> np.ndarray:
        if self._open:
            i, j = (np.concatenate(x) for x in zip(*self._open, strict=True))
            nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = np.arange(len(self.label))
            root[nodes] = nodes[labels(len(nodes), at[: len(i)], at[len(i) :])]
            self.label = root[self.label]
            self._open, self._held = [], 0
        return self.label


def link_tiles(v: np.ndarray, z: np.ndarray, at: np.ndarray, far: np.ndarray, radius: float, merged: Merged, skip=None) -> None:
    """Link every two of the rows ``at`` (in order of ``far``, their distance from the origin) within the radius.

    ``z`` has coordinates on a few orthonormal axes in single precision: a pair is compared on them first, with room for rounding, then by
    its full distance in double precision. Tiles whose distances from the origin differ by more than the radius are left out, as are those
    that ``skip`` names and those that are one component already.
    """
    part = z[at].astype(np.float64)
    half = (part**2).sum(axis=1) / 2
    unit = np.ones((len(at), 1), np.float32)
    minus = (-half[:, None]).astype(np.float32)
    left, right = np.hstack([z[at], minus, unit]), np.ascontiguousarray(np.hstack([z[at], unit, minus]).T)
    one = (0, 1)
    for s in range(0, len(at), TILE):
        e = min(s + TILE, len(at))
        if s:  # what the first tiles have linked
            one = merged.settled(len(at))[at[s:e]]
            one = one.min(), one.max()
        for t in range(s, len(at), TILE):
            f = min(t + TILE, len(at))
            if far[at[t]] - far[at[e - 1]] > radius * (1 + 1e-6) + 1e-9:
                break
            if skip is not None and skip(s, e, t, f):
                continue
            if s and one[0] == one[1] and (merged.label[at[t:f]] == one[0]).all():
                continue
            room = 1e-7 + 8e-6 * float(half[s:e].max() + half[t:f].max())
            hit = np.flatnonzero(left[s:e] @ right[:, t:f] >= np.float32(-radius * radius / 2 - room))
            if not len(hit):
                continue
            i, j = np.divmod(hit, f - t)
            i, j = i + s, j + t
            ahead = i < j
            i, j = at[i[ahead]], at[j[ahead]]
            for k in range(0, len(i), 16384):
                p, q = i[k : k + 16384], j[k : k + 16384]
                ok = ((v[p] - v[q]) ** 2).sum(axis=1) <= radius * radius * (1 + 1e-9)
                merged.link(p[ok], q[ok])


def near_components(v: np.ndarray, space: sp.Space) -> np.ndarray:
    """Component labels of the rows of one part, linked within the radius; compared cell by cell, in tiles ordered by distance from the origin."""
    merged = Merged(len(v))
    z = (v @ sp.random_axes(v.shape[1], sp.FILTER, 29)).astype(np.float32)
    far = np.linalg.norm(v, axis=1)
    for at in sp.cells((v @ space.axes).astype(np.float32), space.overlap):
        link_tiles(v, z, at[np.argsort(far[at], kind="stable")], far, space.radius, merged)
    return merged.settle()


def band_components(v: np.ndarray, space: sp.Bands, bands: tuple[int, int]) -> np.ndarray:
    """Component labels of the rows of two ``bands`` (which may be the same), every row of one compared with every row of the other."""
    far = np.linalg.norm(v, axis=1)
    order = np.argsort(far, kind="stable")
    low, high = np.searchsorted(space.edges, far[order] - 1e-9), np.searchsorted(space.edges, far[order] + 1e-9)

    def one_band(s: int, e: int, t: int, f: int) -> bool:
        return bands[0] != bands[1] and low[s] == high[e - 1] == low[t] == high[f - 1]

    merged = Merged(len(v))
    link_tiles(v, (v @ space.axes).astype(np.float32), order, far, space.radius, merged, one_band)
    return merged.settle()


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's connected component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def local_clusters(table: DataFrame, space: sp.Forest | sp.Bands, n_atoms: int) -> DataFrame:
    """``frame_id, label``: for each part, the frames of its clusters of two or more with the smallest id of the cluster."""
    part_of = {key: part for part, key in enumerate(sp.part_keys(table.sparkSession, space.parts))}

    def cluster(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sp.gathered(batches, n_atoms, space)
        if got is not None:
            key, fid, v, extra, rep = got
            part = part_of[key]
            lab = band_components(v, space, space.pairs[part]) if isinstance(space, sp.Bands) else near_components(v, space.tree_of(part))
            size = np.bincount(lab, minlength=len(fid))
            some = size[lab] > 1
            ids, lab = np.concatenate([fid[some], extra]), np.concatenate([fid[lab[some]], rep])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lab)], ["frame_id", "label"])

    return sp.spread(table, space, n_atoms, 1).mapInArrow(cluster, "frame_id long, label long")


def components(edges: DataFrame, one_task: int = 2_000_000) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` longs): the smallest node it is linked to, directly or through others.

    Up to ``one_task`` edges (a checked count) are solved in one task. More are solved by rounds of hooking to the smallest neighbour and
    pointer jumping, each written to the shared folder; the rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(edges.where("a <> b").distinct())
    n = edges.limit(one_task + 1).count()
    if n <= one_task:

        def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                a, b = (np.concatenate([x.column(k).to_numpy() for x in got]) for k in ("a", "b"))
                nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = nodes[labels(len(nodes), at[: len(a)], at[len(a) :])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

        return edges.repartition(1).mapInArrow(solve, "node long, root long")
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    roots = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        step = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("_m")).withColumnRenamed("a", "node")
        hooked = roots.join(step, "node").select("node", F.least("root", "_m").alias("root"))
        parents = hooked.select(F.col("node").alias("root"), F.col("root").alias("_p"))
        jumped = materialize(hooked.join(parents, "root", "left").select("node", F.coalesce("_p", "root").alias("root")))
        moved = jumped.join(roots.withColumnRenamed("root", "_old"), "node").where("root <> _old").limit(1).count()
        forget(roots)
        roots = jumped
        if not moved:
            return roots


def cluster_frames(table: DataFrame, n_atoms: int = 22, radius: float = RADIUS, part: int = sp.PART, overlap: float | None = sp.OVERLAP, trees: int = 2) -> DataFrame:
    """``frame_id, cluster`` of every frame that another frame lies within ``radius`` of; ``cluster`` is the smallest id of its cluster.

    Density clustering (a frame with a neighbour is a core point) over parts of the reduced vectors that overlap by ``overlap`` standard
    deviations of one coordinate of a difference of the radius; local clusters that share a frame are merged. ``trees`` independent divisions
    are made, and a link is found unless each of them parts it: the chance is about 1e-4 for a link of the full radius and falls steeply
    below it (README). With ``overlap=None`` no link can be lost: frames are dealt into bands by their distance from an origin and
    every two bands that the radius can span are compared in full, at a cost that grows with the square of the frames. ``table`` has
    ``frame_id, vec`` (packed frames); the same id twice counts once, exact copies are one point of the search and all members of its
    cluster. An empty table gives no rows.
    """
    n = table.count()
    if overlap is None:
        space: sp.Forest | sp.Bands = sp.bands(sp.sample_vectors(table, n, n_atoms), n, radius, part)
    else:
        space = sp.space_of(table, n, n_atoms, radius, part, overlap, trees)
    local = materialize(local_clusters(table, space, n_atoms))
    member = local.groupBy("frame_id").agg(F.min("label").alias("label"), F.max("label").alias("_top"), F.collect_set("label").alias("_all"))
    member = materialize(member.select("frame_id", "label", F.when(F.col("_top") != F.col("label"), F.col("_all")).alias("_all")))
    links = member.where("_all is not null").select("label", F.explode("_all").alias("b")).select(F.col("label").alias("a"), "b")
    chained = local.select("label").distinct().join(member.where("frame_id <> label").select(F.col("frame_id").alias("label"), F.col("label").alias("b")), "label").select(F.col("label").alias("a"), "b")
    roots = materialize(components(links.union(chained)).where("node <> root").select(F.col("node").alias("label"), "root"))
    merged = member.select("frame_id", "label").join(sized(roots), "label", "left").select("frame_id", F.coalesce("root", "label").alias("cluster"))
    copied = local.where("frame_id <> label").select(F.col("label").alias("frame_id")).distinct().join(merged, "frame_id", "left_anti").select("frame_id", F.col("frame_id").alias("cluster"))
    return merged.union(copied)


def cluster_pairs(members: DataFrame, block: int = 4096) -> DataFrame:
    """``frame_id_a, frame_id_b``: every pair of frames of one cluster, smaller id first. Members meet block by block of about ``block``, so
    the pairs of a large cluster are many tasks."""
    members = materialize(members)
    large = materialize(members.groupBy("cluster").count().where(F.col("count") > block).select("cluster", F.ceil(F.col("count") / block).cast("int").alias("_n")))
    rows = members.join(sized(large), "cluster", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    place = F.pmod(F.xxhash64("frame_id"), F.col("_n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = rows.select("cluster", place.alias("_r"), F.col("frame_id").alias("frame_id_a"), every.alias("_c"))
    b = rows.select("cluster", place.alias("_c"), F.col("frame_id").alias("frame_id_b"), every.alias("_r"))
    return a.join(b, ["cluster", "_r", "_c"]).where("frame_id_a < frame_id_b").select("frame_id_a", "frame_id_b")


#: Members from which a cluster is described in parts.
LARGE = 10_000
#: Means of large clusters (one vector each) that may be broadcast.
MEANS = 20_000
DESCRIBED = "cluster long, size long, medoid long, typical array<long>, spread double"


def describe_clusters(members: DataFrame, table: DataFrame, n_atoms: int = 22, typical: int = 3, large: int = LARGE) -> DataFrame:
    """``cluster, size, medoid, typical, spread``: size, the ``typical`` members nearest to the cluster's mean, the first of them, and the
    root mean squared distance from the mean.

    The member nearest to the mean is the one with the least sum of squared distances to all members, so medoids need no pairs. Ties go to
    the smaller id. Clusters of up to ``large`` members are described where their members meet; larger ones by mergeable sums.
    """
    members = materialize(members)
    big = materialize(members.groupBy("cluster").count().where(F.col("count") > large).select("cluster"))
    rows = table.join(members, "frame_id")
    if not big.limit(1).count():
        return _describe_small(rows, n_atoms, typical)
    big = sized(big)
    return _describe_small(rows.join(big, "cluster", "left_anti"), n_atoms, typical).unionByName(_describe_large(rows.join(big, "cluster", "left_semi"), n_atoms, typical))


def _describe_small(rows: DataFrame, n_atoms: int, typical: int) -> DataFrame:
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in sp.groups(batches, ["cluster"]):
            ids, at = np.unique(group["frame_id"].to_numpy(), return_index=True)
            v = sp.vectors(framecodec.unpack(group["vec"].combine_chunks().take(pa.array(at)), n_atoms))
            d = np.round(((v - v.mean(axis=0)) ** 2).sum(axis=1), 12)
            best = ids[np.lexsort((ids, d))[:typical]].tolist()
            out.append((group["cluster"][0].as_py(), len(ids), best[0], best, round(float(np.sqrt(d.mean())), 6)))
            if len(out) == 4096:
                yield _record(out)
                out = []
        if out:
            yield _record(out)

    return rows.select("cluster", "frame_id", "vec").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(describe, DESCRIBED)


def _record(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["cluster", "size", "medoid", "typical", "spread"])


def _describe_large(rows: DataFrame, n_atoms: int, typical: int) -> DataFrame:
    """One vector sum per cluster and Arrow batch, merged, then one distance per member; the nearest of each salted part meet at the end."""
    rows = rows.dropDuplicates(["frame_id"])
    width = 3 * n_atoms

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, at = np.unique(batch.column("cluster").to_numpy(), return_inverse=True)
                v = sp.vectors(framecodec.unpack(batch.column("vec"), n_atoms))
                total = np.zeros((len(c), width))
                np.add.at(total, at, v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width, dtype=np.int32)), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.bincount(at).astype(np.int64)), lists], ["cluster", "n", "total"])

    parts = rows.select("cluster", "vec").mapInArrow(sums, "cluster long, n long, total array<double>")
    mean = materialize(parts.groupBy("cluster").agg(F.sum("n").alias("size"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total")))

    def off(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = sp.vectors(framecodec.unpack(batch.column("vec"), n_atoms))
                m = batch.column("total").flatten().to_numpy().reshape(len(v), width) / batch.column("size").to_numpy()[:, None]
                d = ((v - m) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("size"), batch.column("frame_id"), pa.array(np.round(d, 12))], ["cluster", "size", "frame_id", "d"])

    far = rows.join(sized(mean, MEANS), "cluster").select("cluster", "size", "frame_id", "vec", "total").mapInArrow(off, "cluster long, size long, frame_id long, d double")
    salt = F.pmod(F.xxhash64("frame_id"), F.lit(64))
    best = Window.partitionBy("cluster", salt).orderBy("d", "frame_id")
    some = far.withColumn("_r", F.row_number().over(best)).groupBy("cluster", "size", salt.alias("_s")).agg(F.sum("d").alias("_d"), F.collect_list(F.when(F.col("_r") <= typical, F.struct("d", "frame_id"))).alias("_t"))
    done = some.groupBy("cluster", "size").agg(F.sum("_d").alias("_d"), F.slice(F.sort_array(F.flatten(F.collect_list("_t"))), 1, typical).alias("_t"))
    return done.select("cluster", "size", F.col("_t")[0]["frame_id"].alias("medoid"), F.col("_t")["frame_id"].alias("typical"), F.round(F.sqrt(F.col("_d") / F.col("size")), 6).alias("spread"))


def found(frames: DataFrame) -> DataFrame:
    return cluster_pairs(cluster_frames(plausible(frames)))


def groups_of(frames: DataFrame) -> DataFrame:
    table = plausible(frames)
    return describe_clusters(cluster_frames(table), table)
