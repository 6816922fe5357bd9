"""Balanced label propagation: equal texts gather in one shard while every shard keeps an equal number of documents.

The graph's links join equal texts through a hub for each text, so the state is one row for each text and shard that
holds copies of it, never a pair of documents. Documents start in equal ranges of a hash order. In each round the
copies of a text move from its lesser shards to its greatest one that still has room; a shard takes no more than its
quota. Documents without copies fill what room is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import near_equal_buckets, ranked, stored

SHARDS = 24


def quotas(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def _range_of(rank: Column, sizes: list[int], values: list[int]) -> Column:
    """For a rank in consecutive ranges of these sizes, the value of its range."""
    at, ends = 0, []
    for size, value in zip(sizes, values, strict=True):
        if size:
            ends.append((at := at + size, value))
    out = F.lit(ends[-1][1] if ends else 0).cast("long")
    for end, value in reversed(ends[:-1]):
        out = F.when(rank < end, F.lit(value).cast("long")).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """Deals rows (doc_id, text) to shards: doc_id, size, text_crc32, shard, slot, group_rows (rows with the same text).

    Counts differ by at most one. A null text counts as an empty one. Repeated rows and doc_ids are documents of their
    own; an empty table gives an empty result; columns other than doc_id and text aren't read. A text with more copies
    than a shard holds fills whole shards and goes on in others.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"))
    base = base.withColumn("h", F.xxhash64("doc_id", "g"))
    ties = ["doc_id", "g"]
    n_rows = docs.count()
    quota, buckets = quotas(n_rows, shards), near_equal_buckets(n_rows)
    placed = ranked(base, [], "h", ties, buckets)
    rows = stored(placed.withColumn("shard", _range_of(F.col("rank"), quota, list(range(shards))).cast("int")).drop("rank"), "rows")
    parts = rows.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(parts.withColumn("total", F.sum("n").over(Window.partitionBy("g"))).where("total > 1"), "parts")
    groups = parts.select("g", "total").distinct()
    load = _load(parts, shards)
    for turn in range(rounds):
        room = F.array(*[F.lit(max(0, q - x)) for q, x in zip(quota, load, strict=True)])
        open_n = F.when(F.element_at(room, F.col("shard") + 1) > 0, F.struct("n", (-F.col("shard")).alias("s")))
        best = parts.withColumn("to", F.max(open_n).over(Window.partitionBy("g")))
        moving = F.col("to").isNotNull() & (F.struct("n", (-F.col("shard")).alias("s")) < F.col("to"))
        wish = best.where(moving).select("g", "shard", "n", "total", (-F.col("to.s")).alias("target"), F.xxhash64("g", F.lit(turn)).alias("h"))
        queued = ranked(wish, ["target"], "h", ["g", "shard"], buckets, "before", "n")
        moved = queued.withColumn("k", F.least("n", F.element_at(room, F.col("target") + 1) - F.col("before"))).where("k > 0")
        moved = stored(moved.select("g", "shard", "target", "k", "total"), "moves")
        if moved.isEmpty():
            break
        change = parts.select("g", "shard", "n", "total").unionByName(moved.select("g", "shard", (-F.col("k")).alias("n"), "total")).unionByName(moved.select("g", F.col("target").alias("shard"), F.col("k").alias("n"), "total"))
        parts = stored(change.groupBy("g", "shard", "total").agg(F.sum("n").alias("n")).where("n > 0"), "parts")
        load = _load(parts, shards)
    first = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = ranked(parts.withColumn("h", F.xxhash64("g")), ["shard"], "h", ["g"], buckets, "slot", "n")
    slots = slots.withColumn("first", F.coalesce(F.sum("n").over(first), F.lit(0)))
    spots = slots.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("first", "n", "shard", "slot"))).alias("spots"), F.first("total").alias("group_rows"))  # at most ``shards`` to a text
    linked = ranked(rows.drop("shard"), ["g"], "h", ["doc_id"], buckets, beside=spots)
    spot = F.element_at(F.filter("spots", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"])), 1)
    linked = linked.withColumn("spot", spot).select("doc_id", "size", "text_crc32", F.col("spot.shard").alias("shard"), (F.col("spot.slot") + F.col("rank") - F.col("spot.first")).alias("slot"), "group_rows")
    single = ranked(rows.drop("shard").join(groups.select("g"), "g", "left_anti"), [], "h", ties, buckets)
    rooms = [q - x for q, x in zip(quota, load, strict=True)]
    shift = [x - sum(rooms[:s]) for s, x in enumerate(load)]
    single = single.select("doc_id", "size", "text_crc32", _range_of(F.col("rank"), rooms, list(range(shards))).cast("int").alias("shard"), (F.col("rank") + _range_of(F.col("rank"), rooms, shift)).alias("slot"), F.lit(1).cast("long").alias("group_rows"))
    return linked.unionByName(single)


def _load(parts: DataFrame, shards: int) -> list[int]:
    """Grouped rows of each shard."""
    found = {int(r[0]): int(r[1]) for r in parts.groupBy("shard").agg(F.sum("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def op8_sharding(docs: DataFrame) -> DataFrame:
    """Shards of all documents under the law of equal counts."""
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows")
