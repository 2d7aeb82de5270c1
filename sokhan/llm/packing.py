"""Problem 8: filling fixed-capacity containers with items.

Method: planning on the histogram of lengths. Best fit decreasing runs over counts instead of items: all items of a length go, as many
as fit, into the runs of packs with the smallest sufficient room, so the plan has a few rows per length and the driver sees no more than
one row per possible length (at most the capacity). Items take their planned slots by joining on their rank within their length.
An item larger than the capacity is cut into full pieces and a rest; no other item is divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sokhan.materialize import materialize
from sokhan.operators.ranking import rank_within

PLAN = "length int, first long, last long, pack_from long, per_pack int"


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first pack, items per pack): the item of rank r is in pack first pack + (r - first rank) // per pack."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, packs = [], 0

    def put(room: int, low: int, high: int) -> None:
        if room and low < high:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((low, high))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(order, length)
            if k < len(order):
                room = order[k]
                low, high = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
            else:
                room, low = capacity, packs
                high = packs + -(-left // (capacity // length))
                packs = high
            each = min(room // length, left)
            full = min(high - low, left // each)
            plan.append((length, rank, rank + full * each - 1, low, each))
            rank, left = rank + full * each, left - full * each
            put(room - each * length, low, low + full)
            put(room, low + full, high)
    return plan


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start, length) of ``items`` (doc_id, n_tokens): whole items, and the pieces of those over the capacity."""
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))
    cut = items.filter("n_tokens > 0").select("doc_id", "n_tokens", parts.alias("piece_no"))
    start = F.col("piece_no") * F.lit(capacity)
    return cut.select("doc_id", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("length"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start, length, pack_id): every piece in its pack; ``items`` (doc_id, n_tokens), ids unique. Items without tokens need no room and are left out."""
    spark = items.sparkSession
    cut = pieces(items, capacity)
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.createDataFrame(plan_packs(histogram, capacity) or [(-1, 0, 0, 0, 1)], PLAN)
    ranked = rank_within(cut.withColumn("_key", F.struct("doc_id", "piece_no")), "length", "_key").drop("_key")
    slot = (ranked.length == plan.length) & ranked["rank"].between(plan["first"], plan["last"])
    return ranked.join(F.broadcast(plan), slot).select(
        "doc_id", "piece_no", "start", ranked.length, (F.col("pack_from") + F.floor((F.col("rank") - F.col("first")) / F.col("per_pack"))).alias("pack_id")
    )


def pack_all(sizes: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """``pack`` for each named capacity, with pack_name; sizes are measured once."""
    sizes = materialize(sizes.select("doc_id", "n_tokens"))
    out = None
    for name, capacity in capacities:
        one = pack(sizes, capacity).select(F.lit(name).alias("pack_name"), "pack_id", "doc_id", "piece_no", "start", "length")
        out = one if out is None else out.unionByName(one)
    return out


def pack_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, packs, tokens, fill): fill is the share of all room that is used."""
    sizes = packed.sparkSession.createDataFrame(capacities, "pack_name string, capacity int")
    used = packed.groupBy("pack_name").agg((F.max("pack_id") + 1).alias("packs"), F.sum("length").alias("tokens"))
    return used.join(F.broadcast(sizes), "pack_name").select("pack_name", "capacity", "packs", "tokens", (F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("fill"))
