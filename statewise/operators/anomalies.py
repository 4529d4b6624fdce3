"""Implausible values in measurements: coordinate frames judged against their trajectory, catalog readings against their run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.functions import framecodec
from statewise.functions.arrowgroups import groups
from statewise.operators.islands import islands
from statewise.session import materialize

#: Frames of one context block, and frames on either side of it that are read as context only.
BLOCK, HALO = 256, 32
#: Coordinates beyond this many nm fit no box.
FAR = 100.0
#: Stored frames within which an excursion must be over to count as a spike; half the window of the running centre.
BACK, CENTRE = 6, 7
#: Stored frames with unchanged coordinates of one atom from which that atom counts as stuck.
STUCK = 5
#: Fence = max(upper quartile + IQR_FACTOR x interquartile range, factor x upper quartile), in the trajectory and (looser) in the block.
IQR_FACTOR, MOLECULE_FACTOR, ATOM_FACTOR, BLOCK_LOOSER = 3.0, 6.0, 3.0, 0.7

SCORES = "traj_id long, frame long, frame_id long, s1 double, s2 double, rise1 double, rise2 double, hard boolean, candidate boolean, vec binary"


def _pack(batches: Iterable[pa.RecordBatch], n_atoms: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, x = framecodec.from_lists(batch.column("xyz"), n_atoms)
        if not len(x):
            continue
        traj, frame, fid = (batch.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("traj_id", "frame", "frame_id"))
        block, at = np.divmod(frame, BLOCK)
        whole = np.arange(len(x))
        row = np.concatenate([whole, whole[at < HALO], whole[at >= BLOCK - HALO]])
        blk = np.concatenate([block, block[at < HALO] - 1, block[at >= BLOCK - HALO] + 1])
        vec = framecodec.pack(x).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(traj[row]), pa.array(blk), pa.array(frame[row]), pa.array(fid[row]), vec], ["traj_id", "blk", "frame", "frame_id", "vec"])


def _rise(s: np.ndarray) -> np.ndarray:
    """How far each value stands above the calmest of the BACK values before and of the BACK after it (the higher of the two bases)."""
    n = len(s)
    pad = np.full(BACK, np.inf)
    line = np.concatenate([pad, np.where(np.isfinite(s), s, np.inf), pad])
    view = np.lib.stride_tricks.sliding_window_view(line, BACK).min(axis=1)
    before, after = view[:n], view[BACK + 1 : BACK + 1 + n]
    base = np.maximum(np.where(np.isinf(before), -np.inf, before), np.where(np.isinf(after), -np.inf, after))
    return np.where(np.isinf(base), s, s - base)


def judge_block(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of consecutive stored frames (n, atoms, 3): s1 (distance of the molecule's centre from its running median), s2 (largest distance of
    an atom from its median place), their rises, and whether a frame is impossible in itself or holds a stuck atom."""
    n, atoms = x.shape[:2]
    bad = ~np.isfinite(x)
    hard = (bad | (np.abs(np.where(bad, 0, x)) > FAR)).any(axis=(1, 2)) | (x == 0).all(axis=2).any(axis=1)
    mix = np.sort(np.where(bad, np.inf, x) @ np.array([1.0, 0.6180339887498949, 0.2360679774997897]), axis=1)
    with np.errstate(invalid="ignore"):
        close = (np.abs(np.diff(mix, axis=1)) < 1e-9).any(axis=1)
    for i in np.flatnonzero(close).tolist():
        hard[i] |= len(np.unique(x[i], axis=0)) < atoms
    stuck = np.zeros(n, bool)
    if n >= STUCK:
        same = (x[1:] == x[:-1]).all(axis=2)
        run = np.lib.stride_tricks.sliding_window_view(same, STUCK - 1, axis=0).all(axis=2).any(axis=1)
        for k in range(STUCK):
            stuck[k : k + len(run)] |= run
    nan = np.full(n, np.nan)
    soft = np.flatnonzero(~hard)
    if not len(soft):
        return nan, nan, nan, nan, hard | stuck
    y = x[soft]
    middle = np.median(y, axis=1)
    centre = middle
    m, w = len(soft), min(len(soft), 2 * CENTRE + 1)
    if m > CENTRE:  # a steady drift would stand out where the window is cut off at the ends
        pace = np.median(centre[CENTRE:] - centre[:-CENTRE], axis=0) / CENTRE
        centre = centre - pace * np.arange(m)[:, None]
    near = np.clip(np.arange(m) - CENTRE, 0, m - w)[:, None] + np.arange(w)
    s1, s2 = nan.copy(), nan.copy()
    s1[soft] = np.sqrt(((centre - np.median(centre[near], axis=1)) ** 2).sum(axis=1))
    inner = y - middle[:, None]
    s2[soft] = np.sqrt(((inner - np.median(inner, axis=0)) ** 2).sum(axis=2).max(axis=1))
    return s1, s2, _rise(s1), _rise(s2), hard | stuck


def fence(low: np.ndarray, high: np.ndarray, factor: float) -> np.ndarray:
    return np.maximum(high + IQR_FACTOR * (high - low), factor * high)


def _score(batches: Iterable[pa.RecordBatch], n_atoms: int, vectors: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCORES.split(", ")]
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in list(zip(*out, strict=True))[:9]]
        vec = pa.concat_arrays([o[9] for o in out])
        arrays = [pa.array(c, from_pandas=k in (3, 4, 5, 6)) for k, c in enumerate(cols)]
        return pa.RecordBatch.from_arrays([*arrays, vec], names)

    held = 0
    for group in groups(batches, ["traj_id", "blk"]):
        frame, fid = group["frame"].to_numpy(), group["frame_id"].to_numpy()
        order = np.lexsort((fid, frame))
        order = order[np.r_[True, np.diff(fid[order]) != 0]]
        vec = group["vec"].combine_chunks().take(pa.array(order))
        frame, fid, traj, blk = frame[order], fid[order], group["traj_id"][0].as_py(), group["blk"][0].as_py()
        own = frame // BLOCK == blk
        if not own.any():
            continue
        s1, s2, r1, r2, hard = judge_block(framecodec.unpack(vec, n_atoms))
        candidate = hard.copy()
        for s, factor in ((s1, MOLECULE_FACTOR), (s2, ATOM_FACTOR)):
            if np.isfinite(s).any():
                q = np.nanquantile(s, [0.25, 0.75])
                with np.errstate(invalid="ignore"):
                    candidate |= s > BLOCK_LOOSER * fence(q[0], q[1], factor)
        vec = vec.filter(pa.array(own)) if vectors else pa.nulls(int(own.sum()), pa.binary())
        out.append([np.full(int(own.sum()), traj), frame[own], fid[own], s1[own], s2[own], r1[own], r2[own], hard[own], candidate[own], vec])
        held += int(own.sum())
        if held >= 8192:
            yield flush()
            out, held = [], 0
    if out:
        yield flush()


def frame_scores(frames: DataFrame, n_atoms: int = 22, vectors: bool = False) -> DataFrame:
    """One row per complete frame (deliveries of one ``frame_id`` count once) with its deviation scores, written to the shared folder.

    ``frames`` has ``frame_id, traj_id, frame, xyz``; further columns are ignored. Frames are shuffled by (trajectory, block of BLOCK
    frames) with HALO frames of overlap, so a trajectory that holds most rows is spread over its blocks. Rows with a null id, trajectory or
    frame, and null, short or incomplete ``xyz`` are missing data and get no row. ``vectors`` keeps the coordinates in packed form.
    """
    rows = frames.where("frame_id is not null and traj_id is not null and frame is not null").select(*[F.col(c).cast("long") for c in ("frame_id", "traj_id", "frame")], "xyz")
    packed = rows.mapInArrow(lambda it: _pack(it, n_atoms), "traj_id long, blk long, frame long, frame_id long, vec binary")
    blocks = packed.repartition("traj_id", "blk").sortWithinPartitions("traj_id", "blk")
    return materialize(blocks.mapInArrow(lambda it: _score(it, n_atoms, vectors), SCORES))


def faulty_frames(scores: DataFrame) -> DataFrame:
    """``traj_id, frame, frame_id`` of the frames that cannot be right.

    The scores of a trajectory are summarised by mergeable quantile sketches, one per trajectory, built per partition and merged. A frame
    is faulty if it is impossible in itself or holds a stuck atom, or if a score lies beyond the expanded interquartile fence of its
    trajectory and of its block of frames and the excursion is over within BACK stored frames on both sides (at the ends: on one).
    """
    quartiles = scores.where("not hard").groupBy("traj_id").agg(F.percentile_approx("s1", [0.25, 0.75], 1000).alias("_q1"), F.percentile_approx("s2", [0.25, 0.75], 1000).alias("_q2"))

    def bound(q: str, factor: float):
        return F.greatest(F.col(q)[1] + IQR_FACTOR * (F.col(q)[1] - F.col(q)[0]), factor * F.col(q)[1])

    fences = quartiles.select("traj_id", bound("_q1", MOLECULE_FACTOR).alias("_f1"), bound("_q2", ATOM_FACTOR).alias("_f2"))
    beyond = F.lit(False)
    for s, rise, f in (("s1", "rise1", "_f1"), ("s2", "rise2", "_f2")):
        beyond = beyond | F.coalesce((F.col(s) > F.col(f)) & (F.col(rise) > 0.5 * F.col(f)), F.lit(False))
    return scores.where("candidate").select("traj_id", "frame", "frame_id", "s1", "s2", "rise1", "rise2", "hard").join(fences, "traj_id", "left").where(F.col("hard") | beyond).select("traj_id", "frame", "frame_id")


#: A number with its unit of length, as messages write it (fixed pattern).
READING = r"(?i)([-+]?(?:nan|inf(?:inity)?|\d[\d.,]*(?:e[-+]?\d+)?))\s*(nanomet(?:er|re)s?|nm|[aå]ngstr[oö]ms?|[åÅÅ]|a)(?![a-z0-9])"
#: Readings several times above or below their run's median are faulty; runs with fewer readings have no norm.
TIMES, LEAST = 3.0, 4


def readings(catalog: DataFrame) -> DataFrame:
    """``traj_id, run_no, nm``: the deviation reading of each message in nm (NaN and infinities kept); messages without one have no row."""
    number = F.regexp_extract("errors", READING, 1)
    number = F.when(number.contains(".") & number.contains(","), F.regexp_replace(number, ",", "")).otherwise(F.replace(number, F.lit(","), F.lit(".")))
    word = F.lower(F.regexp_replace(number, r"[-+]", ""))
    value = F.when(word == "nan", F.lit(float("nan"))).when(word.startswith("inf"), F.when(number.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(number.try_cast("double"))
    unit = F.lower(F.regexp_extract("errors", READING, 2))
    parsed = catalog.where(F.col("traj_id").isNotNull() & F.col("errors").rlike(READING)).select(F.col("traj_id").cast("long").alias("traj_id"), "run_no", value.alias("_v"), unit.alias("_u"))
    return parsed.where("_v is not null").select("traj_id", "run_no", F.when(F.col("_u").startswith("n"), F.col("_v")).otherwise(F.col("_v") / 10).alias("nm"))


def faulty_readings(catalog: DataFrame, block: int = 1024) -> DataFrame:
    """``traj_id`` of catalog rows whose reading cannot be right against the other readings of its ``run_no``.

    Faulty: negative or not finite; more than TIMES above or below the run's median (quantile sketches per run, merged across partitions)
    and beyond the run's expanded log-interquartile fence; or one of at least 4 equal neighbours in ``traj_id`` order (zero variance).
    Null messages and messages without a reading are no case; a null ``run_no`` is a run of its own; runs under LEAST readings have no norm.
    """
    r = readings(catalog)
    sane = F.when((F.col("nm") > 0) & (F.col("nm") < float("inf")), F.ln("nm"))
    norm = r.groupBy("run_no").agg(F.percentile_approx(sane, [0.25, 0.5, 0.75], 1000).alias("_q"), F.count(sane).alias("_n"))
    far = F.abs(sane - F.col("_q")[1])
    off = F.coalesce((F.col("_n") >= LEAST) & (far > F.lit(float(np.log(TIMES)))) & (far > IQR_FACTOR * (F.col("_q")[2] - F.col("_q")[0]) / 2), F.lit(False))
    wrong = F.isnan("nm") | (F.abs("nm") == float("inf")) | (F.col("nm") < 0) | ((F.col("nm") == 0) & (F.col("_n") >= LEAST)) | off
    alone = r.join(norm, r.run_no.eqNullSafe(norm.run_no), "left").where(wrong).select("traj_id")
    finite = r.where(~F.isnan("nm")).withColumn("_t", F.round("nm", 7)).withColumn("_r", F.coalesce(F.col("run_no").cast("long"), F.lit(-(2**62))))
    runs = islands(finite, ["_r"], "traj_id", lambda p, c: p["_t"] == c["_t"], ["_t"], F.floor(F.col("traj_id") / block)).where("n >= 4").select("_r", F.col("first.traj_id").alias("_a"), F.col("last.traj_id").alias("_z"), F.col("first._t").alias("_v"))
    same = finite.alias("f").join(runs.alias("g"), (F.col("f._r") == F.col("g._r")) & (F.col("f._t") == F.col("g._v")) & F.col("f.traj_id").between(F.col("g._a"), F.col("g._z"))).select("f.traj_id")
    return alone.union(same).distinct()


def anomalies(frames: DataFrame, catalog: DataFrame, n_atoms: int = 22) -> DataFrame:
    """``traj_id, frame`` of every faulty frame, and with ``frame`` = -1 every trajectory with a faulty catalog reading; each once."""
    bad = faulty_frames(frame_scores(frames, n_atoms)).select("traj_id", "frame")
    return bad.union(faulty_readings(catalog).select("traj_id", F.lit(-1).cast("long").alias("frame"))).distinct()
