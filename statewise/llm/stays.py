"""Runs of repeated or near-repeated events in ordered sequences, collapsed into one event each (problem 4)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.arrowgroups import groups
from statewise.session import materialize

#: Frames of one block; a frame this much after the one before costs nothing; cost of a boundary between two runs.
BLOCK, REACH, PENALTY = 4096, 2, 0.5
#: Cost of a boundary where the events of a run may differ (one unlike event costs 1).
CHANGE = 2.0
#: The segment before the first cut.
BEGIN = -(1 << 62)


def segment(times: list[int], reach: int = REACH, penalty: float = PENALTY) -> list[int]:
    """Start positions of the runs of one entity's events at increasing ``times`` that minimise dissimilarity plus boundaries.

    The dissimilarity within a run is the sum, over neighbours, of the time beyond ``reach`` between them (the events of anything else in
    between); every run costs ``penalty``. It adds up gap by gap, so a gap is bridged exactly if its excess is at most the penalty, whatever
    stands elsewhere; blocks therefore join by that rule. Dynamic programming over the last boundary, with the starts pruned that can never become best again (those whose cost without a
    further boundary already reaches the optimum with one). Of equal optima the one with fewer runs is taken.
    """
    starts, best, back = [], -penalty, []
    costs: list[float] = []
    last = None
    for t, now in enumerate(times):
        over = 0 if last is None else max(0, now - last - reach)
        if over:
            costs = [c + over for c in costs]
        starts.append(t)
        costs.append(best + penalty)
        low = min(costs)
        at = costs.index(low)
        back.append(starts[at])
        best = low
        if len(costs) > 1:
            kept = [k for k, c in enumerate(costs) if c < low + penalty or k == at]
            starts, costs = [starts[k] for k in kept], [costs[k] for k in kept]
        last = now
    cuts, t = [], len(times) - 1
    while t >= 0:
        cuts.append(back[t])
        t = back[t] - 1
    return cuts[::-1]


def _runs(batches: Iterable[pa.RecordBatch], reach: int, penalty: float) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, ...]] = []
    held = 0
    for group in groups(batches, ["traj_id", "blk"]):
        traj = group["traj_id"][0].as_py()
        frame, state = group["frame"].to_numpy(), group["state"].to_numpy()
        order = np.lexsort((frame, state))
        frame, state = frame[order], state[order]
        edges = np.flatnonzero(np.r_[True, state[1:] != state[:-1], True])
        first = np.concatenate([a + np.array(segment(frame[a:z].tolist(), reach, penalty)) for a, z in zip(edges[:-1], edges[1:], strict=True)])
        last = np.r_[first[1:], len(frame)] - 1
        out.append((np.full(len(first), traj), np.full(len(first), group["blk"][0].as_py()), state[first], frame[first], frame[last], last - first + 1))
        held += len(first)
        if held > 8192:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["traj_id", "blk", "state", "first_frame", "last_frame", "n_frames"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["traj_id", "blk", "state", "first_frame", "last_frame", "n_frames"])


def corrected(assignments: DataFrame) -> DataFrame:
    """``traj_id, frame, state`` after corrections: of several rows of one frame the one loaded last holds; then rows without a valid state go."""
    rows = assignments.where("traj_id is not null and frame is not null").groupBy(F.col("traj_id").cast("long").alias("traj_id"), F.col("frame").cast("long").alias("frame"))
    return rows.agg(F.max(F.struct("loaded_at", "state")).alias("_m")).select("traj_id", "frame", F.col("_m.state").cast("long").alias("state")).where("state >= 0")


def stays(assignments: DataFrame, least: int = 1, reach: int = REACH, penalty: float = PENALTY, block: int = BLOCK) -> DataFrame:
    """``traj_id, state, first_frame, last_frame, n_frames, duration``: every stay of a trajectory in a state with at least ``least`` frames.

    Stays of two states may overlap, so the entity is a trajectory's sequence as one state sees it: its events in that state, with everything
    else as gaps. It is segmented by ``segment``; with a penalty below the least cost of a gap (1) a stay ends exactly where a frame
    comes more than ``reach`` after the one before. ``near_runs`` divides a trajectory among all its states instead. Trajectories are cut into blocks of frames, so none fills a task
    alone; only the stays that reach a block's border are merged across borders. ``assignments`` has ``traj_id, frame, state, loaded_at``;
    rows with a null trajectory or frame are left out, null and negative states end nothing and begin nothing, a null ``loaded_at`` is the
    oldest, repeated rows count once. An empty table has no stays.
    """
    rows = corrected(assignments).withColumn("blk", F.floor(F.col("frame") / block).cast("long"))
    runs = rows.repartition("traj_id", "blk").sortWithinPartitions("traj_id", "blk").select("traj_id", "blk", "frame", "state").mapInArrow(lambda it: _runs(it, reach, penalty), "traj_id long, blk long, state long, first_frame long, last_frame long, n_frames long")
    far = reach + penalty
    border = (F.col("first_frame") - F.col("blk") * block < far) | ((F.col("blk") + 1) * block - F.col("last_frame") <= far)
    runs = runs.withColumn("_open", border).where(F.col("_open") | (F.col("n_frames") >= least))
    # closed stays are done: they only pass through, by block; open ones meet their neighbours across borders
    runs = runs.withColumn("_k", F.when(F.col("_open"), F.lit(-1)).otherwise(F.pmod("blk", F.lit(1 << 30))))
    across = Window.partitionBy("traj_id", "state", "_k").orderBy("first_frame")
    begins = F.coalesce(F.col("first_frame") - F.lag("last_frame").over(across) > far, F.lit(True))
    ranked = runs.withColumn("_new", (~F.col("_open") | begins).cast("int")).withColumn("_g", F.when(F.col("_open"), F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))).otherwise(-F.col("first_frame") - 1))
    merged = ranked.groupBy("traj_id", "state", "_k", "_g").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum("n_frames").alias("n_frames"))
    return merged.where(F.col("n_frames") >= least).select("traj_id", "state", "first_frame", "last_frame", "n_frames", (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"))


Dissimilarity = Callable[[np.ndarray, np.ndarray], np.ndarray]


def unlike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """1 for different events, 0 for the same."""
    return (i != j).astype(float)


def label_events(times: np.ndarray, events: np.ndarray, penalty: float, reach: int, between: Dissimilarity, first: int | None = None, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label of every event, whether a run starts at it): the runs of one sequence at least cost.

    A run has one event that occurs in the sequence as its label; it costs ``penalty``, the dissimilarity of each of its events to the label,
    and the time beyond ``reach`` between its neighbours. Dynamic programming over the labels of the last run, pruned: a label whose cost
    is not below the least cost plus ``penalty`` can be given up for a run begun later, so only those below are carried on. ``first`` and
    ``last`` fix the labels of the first and last event. Ties go to the run that goes on, then to the smaller label.
    """
    labels, index = np.unique(events, return_inverse=True)
    cost = between(labels[:, None], labels[None, :]).astype(float)
    near = [[(d, y) for y, d in enumerate(row) if d < penalty] for row in cost.tolist()]
    rows, at, over = cost.tolist(), index.tolist(), np.maximum(0, np.diff(times) - reach).tolist()
    n = len(at)
    begins: list[list[int]] = [[0] for _ in labels]  # of each label the starts of its candidate runs, and the label of the run before
    came: list[list[int]] = [[-1] for _ in labels]
    if first is None:
        alive = {k: penalty + c for k, c in enumerate(rows[at[0]])}
        low = min(alive.values())
        alive = {k: c for k, c in alive.items() if c < low + penalty + 1e-9}
    else:
        k = int(np.searchsorted(labels, first))
        alive = {k: rows[at[0]][k]}
    for t in range(1, n):
        x, gap = at[t], over[t - 1]
        if not gap and len(alive) == 1 and x in alive:
            continue  # the one run goes on at no cost, and no other can become better
        least, best = min((c, k) for k, c in alive.items())
        limit = least + penalty
        row, new = rows[x], {}
        for k, c in alive.items():
            if c + gap <= limit + 1e-12:
                new[k] = c + gap + row[k]
            else:
                new[k] = limit + row[k]
                begins[k].append(t)
                came[k].append(best)
        for d, y in near[x]:
            if y not in alive:
                new[y] = limit + d
                begins[y].append(t)
                came[y].append(best)
        low = min(new.values())
        alive = {k: c for k, c in new.items() if c < low + penalty + 1e-9}
    k = min((c, k) for k, c in alive.items())[1] if last is None else int(np.searchsorted(labels, last))
    out, starts = np.empty(n, labels.dtype), np.zeros(n, bool)
    t = n - 1
    while t >= 0:
        place = bisect_right(begins[k], t) - 1
        start = begins[k][place]
        out[start : t + 1], starts[start] = labels[k], True
        k, t = came[k][place], start - 1
    return out, starts


def _labelled(batches: Iterable[pa.RecordBatch], penalty: float, reach: int, between: Dissimilarity) -> Iterator[pa.RecordBatch]:
    names = ["traj_id", "seg", "state", "first_frame", "last_frame", "n_frames", "n_unlike", "closes"]
    for group in groups(batches, ["traj_id", "seg"]):
        frame, state, fixed = (group[k].to_numpy() for k in ("frame", "state", "fixed"))
        order = np.argsort(frame, kind="stable")
        frame, state, fixed = frame[order], state[order], fixed[order]
        seg = group["seg"][0].as_py()
        first = int(state[0]) if frame[0] == seg else None
        ends = bool(fixed[-1]) and frame[-1] != seg
        label, starts = label_events(frame, state, penalty, reach, between, first, int(state[-1]) if ends else None)
        starts[0] = True
        a = np.flatnonzero(starts)
        z = np.r_[a[1:], len(frame)]
        odd = np.add.reduceat((label != state).astype(np.int64), a)
        count = z - a
        if ends:  # the last event is the first of the next segment
            count[-1] -= 1
        closes = np.zeros(len(a), bool)
        closes[-1] = ends
        columns = [np.full(len(a), group["traj_id"][0].as_py()), np.full(len(a), seg), label[a], frame[a], frame[z - 1], count, odd, closes]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def near_runs(assignments: DataFrame, penalty: float = CHANGE, reach: int = REACH, between: Dissimilarity = unlike, least: float = 1.0, block: int = BLOCK) -> DataFrame:
    """``traj_id, state, first_frame, last_frame, n_frames, n_unlike, duration``: every trajectory as runs of near-identical states.

    Each run has a state as its label, its number of frames, how many of them are in another state, and its length in time; the division has the
    least sum of dissimilarities (``between``: 0 for equal states, at least ``least`` for others), time beyond ``reach`` between neighbours
    and ``penalty`` per run (``label_events``). It does not depend on ``block``: sequences are cut only at frames in the middle of
    more than 2 penalty / least consecutive frames in one state, where every optimum has that state, at the first of each block of
    frames; a stretch without such a frame stays whole. Input as for ``stays``. An empty table has no runs.
    """
    m = int(np.floor(penalty / least))
    if m >= block:
        raise ValueError("the penalty spans more frames than a block has")
    rows = corrected(assignments).withColumn("blk", F.floor(F.col("frame") / block).cast("long"))
    at = F.col("frame") - F.col("blk") * block
    own = rows.withColumn("_own", F.lit(True))
    halo = own.where(at < m).withColumn("blk", F.col("blk") - 1).unionByName(own.where(at >= block - m).withColumn("blk", F.col("blk") + 1)).withColumn("_own", F.lit(False))
    near = Window.partitionBy("traj_id", "blk").orderBy("frame").rangeBetween(-m, m)
    steady = (F.count("state").over(near) == 2 * m + 1) & (F.min("state").over(near) == F.max("state").over(near))
    rows = own.unionByName(halo).withColumn("_steady", steady).where("_own")
    inside = Window.partitionBy("traj_id", "blk")
    rows = materialize(rows.withColumn("_cut", F.min(F.when(F.col("_steady"), F.col("frame"))).over(inside)).drop("_own", "_steady"))
    blocks = rows.groupBy("traj_id", "blk").agg(F.first("_cut").alias("_cut"))
    before = F.last("_cut", True).over(Window.partitionBy("traj_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("traj_id", "blk", F.coalesce(before, F.lit(BEGIN)).alias("_before"))
    placed = rows.join(blocks, ["traj_id", "blk"])
    is_cut = F.coalesce(F.col("frame") == F.col("_cut"), F.lit(False))
    placed = placed.withColumn("seg", F.when(F.col("frame") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_before"))).withColumn("fixed", is_cut)
    twice = placed.where("fixed").withColumn("seg", F.col("_before"))
    events = placed.unionByName(twice).select("traj_id", "seg", "frame", "state", "fixed")
    kinds = "traj_id long, seg long, state long, first_frame long, last_frame long, n_frames long, n_unlike long, closes boolean"
    runs = events.repartition("traj_id", "seg").sortWithinPartitions("traj_id", "seg").mapInArrow(lambda it: _labelled(it, penalty, reach, between), kinds)
    # a run that closes a segment goes on in the first of the next; a chain of such runs gets the first frame of its first
    follows = Window.partitionBy("traj_id").orderBy("first_frame", F.desc("closes"), "seg")
    runs = runs.where("n_frames > 0 or closes")
    border = runs.where("closes or first_frame = seg").withColumn("_new", (~F.coalesce(F.lag("closes").over(follows), F.lit(False))).cast("int"))
    border = border.withColumn("_g", F.sum("_new").over(follows.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy("traj_id", "_g", "state").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum("n_frames").alias("n_frames"), F.sum("n_unlike").alias("n_unlike"))
    done = runs.where("not (closes or first_frame = seg)").unionByName(joined, allowMissingColumns=True)
    return done.select("traj_id", "state", "first_frame", "last_frame", "n_frames", "n_unlike", (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"))


def found(assignments: DataFrame) -> DataFrame:
    return stays(assignments, least=6).select("traj_id", F.col("state").cast("int").alias("state"), "first_frame", "last_frame")


SQL_STAYS = """
WITH held AS (
  SELECT traj_id, frame, max(loaded_at) AS at FROM assignments WHERE traj_id IS NOT NULL AND frame IS NOT NULL GROUP BY 1, 2),
rows_ AS (
  SELECT DISTINCT a.traj_id, a.frame, a.state FROM assignments a JOIN held h ON a.traj_id = h.traj_id AND a.frame = h.frame AND a.loaded_at = h.at WHERE a.state >= 0),
marked AS (
  SELECT *, CASE WHEN frame - lag(frame) OVER w <= 2 THEN 0 ELSE 1 END AS new_ FROM rows_ WINDOW w AS (PARTITION BY traj_id, state ORDER BY frame)),
numbered AS (
  SELECT *, sum(new_) OVER (PARTITION BY traj_id, state ORDER BY frame) AS run FROM marked),
stays AS (
  SELECT traj_id, state, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM numbered GROUP BY traj_id, state, run)
"""
