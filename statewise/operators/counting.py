"""Assignments as a long table (traj_id, frame, state): corrections, lag pairs, counts, relabelling, inversion, likelihood.

A state is null where a frame was trimmed; a frame that is not stored is padding. Negative states are read as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.session import materialize, shuffle_partitions

#: Frames per block: lag pairs and strides are found per (trajectory, block), so a long trajectory is many tasks.
BLOCK = 4096


def latest(assignments: DataFrame) -> DataFrame:
    """``traj_id, frame, state`` after corrections: of the rows of one frame the one loaded last (ties: the larger state); negative is null."""
    rows = assignments.where("traj_id is not null and frame is not null").groupBy("traj_id", "frame").agg(F.max(F.struct("loaded_at", "state")).alias("_m"))
    return rows.select("traj_id", "frame", F.when(F.col("_m.state") >= 0, F.col("_m.state")).alias("state"))


def numbered(df: DataFrame, key: str, order: list[str], name: str = "frame") -> DataFrame:
    """``df`` with the row number (from 0) of every row within its ``key``, in ``order``; rows with a null key are left out.

    Rows are range-partitioned by key and order and written so; a row's number is its place within its partition plus the rows of its key in
    the partitions before. A key that holds most rows is many partitions.
    """
    n = max(1, shuffle_partitions(df.sparkSession))
    rows = materialize(df.where(F.col(key).isNotNull()).repartitionByRange(n, key, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = rows.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    place = F.row_number().over(Window.partitionBy(key, "_pid").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(starts, [key, "_pid"]).withColumn(name, (F.col("_at") + F.col("_place")).cast("long")).drop("_pid", "_place", "_at")


def as_sequence(df: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Any ordered table as (traj_id, frame, state): frames are row numbers from 0 in ``order`` within ``key``."""
    rows = numbered(df.select(F.col(key), *order, state.alias("_state")), key, order)
    return rows.select(F.col(key).alias("traj_id"), "frame", F.col("_state").alias("state"))


def lag_pairs(states: DataFrame, lags: list[int], sliding: bool = True) -> DataFrame:
    """``lag, i, j``: the states at frames t and t + lag of one trajectory, for every t (sliding) or every lag-th t from the first valid frame.

    Pairs that touch a null or missing state are dropped. Each block of frames (BLOCK, or the largest lag if that is more) is read with the first max(lags) frames of the next one, so
    the window is bounded and a trajectory that holds most rows is spread over its blocks.
    """
    if not lags or min(lags) < 1:
        raise ValueError("lags must be at least 1")
    block = max(BLOCK, *lags)
    rows = states.where("state is not null").withColumn("_b", F.floor(F.col("frame") / block)).withColumn("_own", F.lit(True))
    halo = rows.where(F.col("frame") - F.col("_b") * block < max(lags)).withColumn("_b", F.col("_b") - 1).withColumn("_own", F.lit(False))
    both = rows.unionByName(halo)
    base = Window.partitionBy("traj_id", "_b").orderBy("frame")
    later = F.array(*[F.struct(F.lit(k).alias("lag"), F.first("state").over(base.rangeBetween(k, k)).alias("j")) for k in lags])
    both = both.withColumn("_p", later).where("_own")
    if not sliding:
        start = states.where("state is not null").groupBy("traj_id").agg(F.min("frame").alias("_f0"))
        both = both.join(start, "traj_id")
    pairs = both.select("frame", *([] if sliding else ["_f0"]), F.col("state").alias("i"), F.explode("_p").alias("_p")).where("_p.j is not null")
    if not sliding:
        pairs = pairs.where((F.col("frame") - F.col("_f0")) % F.col("_p.lag") == 0)
    return pairs.select(F.col("_p.lag").alias("lag"), "i", F.col("_p.j").alias("j"))


def transition_counts(states: DataFrame, lags: list[int], sliding: bool = True) -> DataFrame:
    """``lag, i, j, c``: how often a trajectory is in i and, a lag later, in j. Counts are combined before the shuffle."""
    return lag_pairs(states, lags, sliding).groupBy("lag", "i", "j").agg(F.count(F.lit(1)).alias("c"))


def transition_matrix(counts: DataFrame) -> DataFrame:
    """``i, j, p``: counts divided by their row's sum; rows without counts have no entries."""
    total = counts.groupBy("i").agg(F.sum("c").alias("_t"))
    return counts.join(total, "i").where("_t > 0").select("i", "j", (F.col("c") / F.col("_t")).alias("p"))


def symmetrize(counts: DataFrame) -> DataFrame:
    """``i, j, c``: half the sum of the counts and their transpose."""
    both = counts.select("i", "j", "c").union(counts.select("j", "i", "c"))
    return both.groupBy("i", "j").agg((F.sum("c") / 2).alias("c"))


def populations(counts: DataFrame) -> DataFrame:
    """``i, v``: share of all (symmetric) counts in each row."""
    rows = counts.groupBy("i").agg(F.sum("c").alias("_s"))
    return rows.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("_t")))).select("i", (F.col("_s") / F.col("_t")).alias("v"))


def rate_matrix(counts: DataFrame, states: DataFrame, proper: bool = False) -> DataFrame:
    """``i, j, k``: counts over the dwell (frames spent in i). The diagonal is minus the row's raw count sum minus C_ii / dwell; with
    ``proper`` it is minus the sum of the other rates of the row."""
    dwell = states.where("state is not null").groupBy(F.col("state").alias("i")).agg(F.count(F.lit(1)).alias("_d"))
    rates = counts.join(dwell, "i").withColumn("k", F.col("c") / F.col("_d"))
    off = rates.where("i <> j").select("i", "j", "k")
    if proper:
        return off.union(off.groupBy("i").agg((-F.sum("k")).alias("k")).select("i", F.col("i").alias("j"), "k"))
    diagonal = rates.groupBy("i").agg((-F.sum("c") - F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("k"))), F.lit(0.0))).alias("k"))
    return off.union(diagonal.select("i", F.col("i").alias("j"), "k"))


def rates_from_transitions(tprob: DataFrame) -> DataFrame:
    """``i, j, k``: off-diagonal probabilities, and minus their row's sum on the diagonal."""
    off = tprob.where("i <> j").select("i", "j", F.col("p").alias("k"))
    return off.union(off.groupBy("i").agg((-F.sum("k")).alias("k")).select("i", F.col("i").alias("j"), "k"))


def log_likelihood(counts: DataFrame, tprob: DataFrame) -> DataFrame:
    """One row ``log_likelihood``: the sum of c log p over counts above 0."""
    return counts.where("c > 0").join(tprob, ["i", "j"]).agg(F.sum(F.col("c") * F.ln("p")).alias("log_likelihood"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def renumbering(states: DataFrame) -> DataFrame:
    """``old, new``: states in use, numbered from 0 in order. The window runs over distinct states only."""
    return states.where("state is not null").select("state").distinct().select(F.col("state").alias("old"), (F.row_number().over(Window.orderBy("state")) - 1).alias("new"))


def apply_mapping(states: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relabelled assignments: ``mapping`` (``old, new``; null or -1: dropped) by state; states outside the mapping and null become null."""
    m = mapping.select(F.col("old").alias("state"), F.when(F.col("new") >= 0, F.col("new")).alias("_new"))
    return states.join(m, "state", "left").select("traj_id", "frame", F.col("_new").alias("state"))


def map_vector(vector: DataFrame, mapping: DataFrame) -> DataFrame:
    """``i, v`` of the kept entries of a vector under their new index."""
    m = mapping.where("new >= 0").select(F.col("old").alias("i"), "new")
    return vector.join(m, "i").select(F.col("new").alias("i"), "v")


def trim_states(counts: DataFrame, drop: DataFrame) -> DataFrame:
    """Counts without the rows and columns of the states in ``drop`` (``state``), renumbered densely in order."""
    kept = counts.join(drop.select(F.col("state").alias("i")), "i", "left_anti").join(drop.select(F.col("state").alias("j")), "j", "left_anti")
    names = counts.select(F.col("i").alias("state")).union(counts.select("j")).distinct().join(drop, "state", "left_anti")
    new = names.select("state", (F.row_number().over(Window.orderBy("state")) - 1).alias("_n"))
    return kept.join(new.select(F.col("state").alias("i"), F.col("_n").alias("_i")), "i").join(new.select(F.col("state").alias("j"), F.col("_n").alias("_j")), "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "c")


def trim_by_distance(assigned: DataFrame, cutoff: float) -> DataFrame:
    """States become null where the distance to the generator exceeds ``cutoff``; a null distance trims nothing."""
    return assigned.withColumn("state", F.when(F.coalesce(F.col("dist") > cutoff, F.lit(False)), None).otherwise(F.col("state")))


def invert(states: DataFrame, buckets: int = 64) -> DataFrame:
    """``state, bucket, members``: the (traj_id, frame) pairs of every state in order, in ``buckets`` lists by trajectory, so that a state
    that holds most frames is not one list."""
    rows = states.where("state is not null")
    return rows.groupBy("state", F.pmod(F.xxhash64("traj_id"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("traj_id", "frame"))).alias("members"))


def cluster_radii(assigned: DataFrame) -> DataFrame:
    """``state, radius``: mean distance of a state's frames to their generator."""
    return assigned.where("state is not null and dist is not null").groupBy("state").agg(F.avg("dist").alias("radius"))


def stride(states: DataFrame, step: int, start: int = 0) -> DataFrame:
    """Every ``step``-th frame of each trajectory from frame ``start``."""
    if step < 1:
        raise ValueError("the step must be at least 1")
    return states if step == 1 and start == 0 else states.where((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))


def stochastic_subsample(states: DataFrame, shrink: int, seed: int = 0, buckets: int = 256) -> DataFrame:
    """floor(n / shrink) frames of each trajectory without replacement, chosen by hash; trajectories too short for one drop out.

    The hashes are cut into ``buckets``; counts per bucket tell which are taken whole, and only the frames of the bucket where the quota
    ends are ranked, so no trajectory is ranked in one task.
    """
    rank = F.xxhash64("traj_id", "frame", F.lit(seed))
    rows = states.withColumn("_h", rank).withColumn("_b", F.pmod(F.shiftrightunsigned(rank, 8), F.lit(buckets)))
    w = Window.partitionBy("traj_id").orderBy("_b")
    sizes = rows.groupBy("traj_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    quota = F.floor(F.sum("_n").over(Window.partitionBy("traj_id")) / shrink) - F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sizes.withColumn("_q", quota).where("_q > 0").select("traj_id", "_b", "_n", "_q")
    ranked = rows.join(open_, ["traj_id", "_b"])
    whole = ranked.where("_q >= _n").select(*states.columns)
    last = ranked.where("_q < _n").withColumn("_r", F.row_number().over(Window.partitionBy("traj_id", "_b").orderBy("_h", "frame"))).where("_r <= _q")
    return whole.unionByName(last.select(*states.columns))


def draws(states: DataFrame, wanted: DataFrame, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """``wanted`` (``state, draw``) with ``traj_id, frame``: for every draw an independent, uniformly random frame of its state.

    A draw's hash is a place among the state's frames; the frames are placed by hashed bucket, so places are counts of the buckets before plus
    a rank inside one bucket, and only buckets that hold a drawn place are ranked. States without frames give no row.
    """
    rows = states.where("state is not null").withColumn("_s", F.pmod(F.xxhash64("traj_id", "frame", F.lit(seed)), F.lit(buckets)))
    sizes = rows.groupBy("state", "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("state").orderBy("_s")
    placed = sizes.withColumn("_at", F.sum("_n").over(w) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy("state")))
    share = F.pmod(F.xxhash64("state", "draw", F.lit(seed), F.lit("draw")), F.lit(1 << 52)) / float(1 << 52)
    total = sizes.groupBy("state").agg(F.sum("_n").alias("_all"))
    places = wanted.join(total, "state").withColumn("_p", F.floor(share * F.col("_all")).cast("long")).drop("_all")
    hit = places.join(placed.drop("_all"), "state").where((F.col("_p") >= F.col("_at")) & (F.col("_p") < F.col("_at") + F.col("_n"))).withColumn("_r", F.col("_p") - F.col("_at"))
    inside = rows.join(hit.select("state", "_s").distinct(), ["state", "_s"], "left_semi")
    ranked = inside.withColumn("_r", (F.row_number().over(Window.partitionBy("state", "_s").orderBy("traj_id", "frame")) - 1).cast("long"))
    return hit.join(ranked, ["state", "_s", "_r"]).select(*wanted.columns, "traj_id", "frame")


def sample_per_state(states: DataFrame, n: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """``state, draw, traj_id, frame``: ``n`` frames of each state.

    Without replacement the first ``n`` by hash (a state with fewer frames gives all it has): each of 64 hashed parts of a state keeps its
    first ``n`` before they meet, so no state is ranked in one task. With replacement ``n`` independent ``draws``.
    """
    if replacement:
        names = states.where("state is not null").select("state").distinct()
        return draws(states, names.select("state", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")), seed) if n > 0 else names.selectExpr("state", "0 as draw", "0L as traj_id", "0L as frame").limit(0)
    rank = F.xxhash64("traj_id", "frame", F.lit(seed))
    rows = states.where("state is not null").withColumn("_h", rank).withColumn("_s", F.pmod(F.xxhash64("frame", "traj_id"), F.lit(64)))
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy("state", "_s").orderBy("_h", "traj_id", "frame"))).where(F.col("_r") <= n)
    ranked = near.withColumn("draw", F.row_number().over(Window.partitionBy("state").orderBy("_h", "traj_id", "frame")) - 1).where(F.col("draw") < n)
    return ranked.select("state", "draw", "traj_id", "frame")


def chunks(lengths: DataFrame, size: int) -> DataFrame:
    """``chunk, traj_id, start, stop``: the frames of all trajectories in id order, cut every ``size`` frames across their borders.

    ``lengths`` has ``traj_id, length``. The running sum is taken over one row per trajectory.
    """
    w = Window.orderBy("traj_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = lengths.where("length > 0").withColumn("_at", F.coalesce(F.sum("length").over(w), F.lit(0)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("length") - 1) / size))))
    start = F.greatest(F.col("chunk") * size - F.col("_at"), F.lit(0))
    stop = F.least((F.col("chunk") + 1) * size - F.col("_at"), F.col("length").cast("long"))
    return rows.select("chunk", "traj_id", start.alias("start"), stop.alias("stop"))


def chunk_hash(pieces: DataFrame) -> DataFrame:
    """``chunk, sha``: SHA-1 of a chunk's description, the key of its checkpoint."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("traj_id", "start", "stop"))), lambda x: F.concat_ws(":", x["traj_id"], x["start"], x["stop"])), ",")
    return pieces.groupBy("chunk").agg(F.sha1(text).alias("sha"))
