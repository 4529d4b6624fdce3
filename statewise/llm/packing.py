"""Filling containers of one capacity with items of varying length (problem 6)."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.session import materialize, shuffle_partitions

#: Tokens a container holds, and tokens of one unit of length: sizes are rounded up to units in the plan.
CAPACITY, UNIT = 8192, 8
#: Rounds of multiplicative weights and their rate.
ROUNDS, RATE = 600, 12.0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized_items(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, tokens``: each document as one piece, or as pieces of ``capacity`` tokens and a rest if it exceeds the capacity.

    Null ids and null texts are no items; an empty text is an item of 0 tokens. A ``doc_id`` stored more than once is one item, as long as
    its longest text.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = rows.mapInArrow(count, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("_all"))
    last = F.greatest(F.floor((F.col("_all") - 1) / capacity), F.lit(0)).cast("int")
    pieces = sizes.select("doc_id", "_all", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return pieces.select("doc_id", "piece", F.least(F.col("_all") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("tokens"))


def price(value: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes 1..capacity of largest total ``value`` that fits ``capacity`` (unbounded knapsack); counts by size."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-15:
            best[c], choice[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    counts = np.zeros(capacity + 1, np.int64)
    c = capacity
    while c > 0:
        if choice[c]:
            counts[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return counts


def configurations(need: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional solution of the configuration program: fillings and how many containers get each, covering ``need`` (items by size).

    Multiplicative weights: every size holds a weight that falls exponentially with the share of its items already covered; each round
    prices a filling by the knapsack, and adds it up to the point where its scarcest size is covered by a fixed step.
    """
    capacity = len(need) - 1
    present = need > 0
    covered = np.zeros(capacity + 1)
    amounts: dict[bytes, float] = {}
    kept: dict[bytes, np.ndarray] = {}
    step = RATE / rounds
    for _ in range(rounds):
        share = np.where(present, covered / np.maximum(need, 1), np.inf)
        low = share[present].min() if present.any() else np.inf
        weight = np.where(present, np.exp(-RATE * 4 * np.clip(share - low, 0, 50)) / np.maximum(need, 1), 0.0)
        filling = price(weight / weight.max(), capacity)
        used = filling > 0
        if not used.any():
            break
        amount = step * float((need[used] / filling[used]).min())
        key = filling.tobytes()
        kept[key] = filling
        amounts[key] = amounts.get(key, 0.0) + amount
        covered += filling * amount
        if low >= 1:
            break
    low = (covered[present] / need[present]).min() if present.any() else 1.0
    scale = 1 / low if low > 0 else 1.0
    return [(kept[k], a * min(scale, 50.0)) for k, a in amounts.items()]


def plan(need: np.ndarray, rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, last rank, first container, items per container) that place every item of every size.

    The fractional containers are rounded down, their places filled as far as items are left; the rest goes, largest first, into the
    fullest containers with room (they are kept as groups of equal content, so the work does not grow with the number of items) and then
    into new ones.
    """
    capacity = len(need) - 1
    left = need.astype(object).copy()
    taken = [0] * (capacity + 1)
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    containers = 0

    def place(size: int, first: int, n: int, each: int) -> None:
        rows.append((size, taken[size], taken[size] + n - 1, first, each))
        taken[size] += n
        left[size] -= n

    for filling, amount in sorted(configurations(need, rounds), key=lambda c: -c[1]):
        many = int(amount)
        sizes = np.flatnonzero(filling).tolist()
        many = min([many, *(int(left[s]) // int(filling[s]) for s in sizes)])
        if many <= 0:
            continue
        for s in sizes:
            place(s, containers, many * int(filling[s]), int(filling[s]))
        free = capacity - int((filling * np.arange(capacity + 1)).sum())
        room.setdefault(free, []).append((containers, many))
        containers += many
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            fits = [f for f in room if f >= size]
            if fits:
                free = min(fits)
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                free, first = capacity, containers
                many = -(-int(left[size]) // (capacity // size))
                containers += many
            each = min(free // size, max(1, int(left[size]) // many))
            used = min(many, int(left[size]) // each)
            place(size, first, used * each, each)
            room.setdefault(free - each * size, []).append((first, used))
            if many > used:
                room.setdefault(free, []).append((first + used, many - used))
    return rows


PLACES = "units int, rank_from long, rank_to long, container_from long, each long"


def pack(items: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, piece, tokens, container``: the container of every item, none filled beyond ``capacity`` tokens.

    ``items`` has ``doc_id, piece, tokens`` with tokens up to ``capacity``. Only the histogram of sizes in units (at most capacity / unit
    rows) reaches the driver, where the configuration program is solved; the plan, a few rows per size and filling, is broadcast. An item
    finds its place by its rank among the items of its size, counted in hashed buckets, so one size may hold most items.
    """
    spark = items.sparkSession
    top = capacity // unit
    rows = materialize(items.select("doc_id", "piece", "tokens", F.greatest(F.ceil(F.col("tokens") / unit), F.lit(1)).cast("int").alias("units")))
    need = np.zeros(top + 1, np.int64)
    for r in rows.groupBy("units").count().collect():
        need[r[0]] = r[1]
    places = spark.createDataFrame(plan(need, rounds) if need.any() else [], PLACES)
    buckets = 8 * shuffle_partitions(spark)
    bucketed = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("units").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("units", "_b").count().select("units", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("units", "_b").orderBy("doc_id", "piece")
    ranked = bucketed.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["units", "_b"]).withColumn("_r", F.col("_r") + F.col("_o"))
    placed = ranked.join(F.broadcast(places), (ranked["units"] == places["units"]) & ranked["_r"].between(places["rank_from"], places["rank_to"]))
    return placed.select("doc_id", "piece", "tokens", (F.col("container_from") + F.floor((F.col("_r") - F.col("rank_from")) / F.col("each"))).alias("container"))


def packed(documents: DataFrame, path: str | None = None) -> DataFrame:
    return pack(sized_items(documents, path or tokenizer_path()))
