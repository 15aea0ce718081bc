"""Sharding by a minimax contiguous partition of atomic groups, all in DataFrame operations.

Equal texts form an atomic group. Groups lie in the order of a 128-bit hash of the text, so a run of groups is a range of
hashes and a row finds its shard from its own hash alone. The smallest feasible shard capacity is found by binary search: a
capacity is feasible if filling shards greedily, each with as many whole groups as fit, needs no more shards than there are;
then the shards are cut there. A group larger than an even share of what is left gets a shard of its own first, and the
rest is divided among the other shards, so that one group of copies doesn't leave shards empty.

The search needs sums, not rows: the hash order is summed into at most 65,536 ranges (a bound, whatever the input), and only
ranges in which a cut can still lie are summed again, finer, until each holds one group. Slots are gapless within a shard;
rows are numbered in buckets of the id's hash, so no shard's rows are ordered in one task.

Defined cases: null text has 0 bytes and the size 16, apart from the empty text as a group; repeated rows each get a slot
(ties broken by id, then size); fewer groups than shards leave shards empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

ROW_OVERHEAD = 16
#: Hash ranges summed and held at once on the driver.
RANGE_BITS = 16
SLOT_BUCKETS = 256


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text, text.isNull()).alias("k1"), F.xxhash64(F.lit(1), text, text.isNull()).alias("k2")]


def _cuts(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where greedy filling ends each shard (a count of items), or None if the shards don't suffice."""
    total, ends, at = list(accumulate(sums)), [], 0
    for _ in range(shards):
        before = total[at - 1] if at else 0
        at = bisect_right(total, before + capacity, lo=at)
        ends.append(at)
        if at == len(sums):
            return ends
    return None


def smallest_capacity(sums: list[int], shards: int) -> int:
    """The least capacity with which ordered items fit into so many contiguous shards."""
    low, high = max([-(-sum(sums) // shards), *sums]), sum(sums)
    while low < high:
        middle = (low + high) // 2
        if _cuts(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open(items: list[tuple], shards: int, low: int, high: int) -> list[int]:
    """Places of the items that hold several groups and in which a greedy cut can lie, for a capacity from low to high.

    Filling whole items with the low capacity gets no further than the true cuts do; filling divisible ones
    with the high capacity gets no less far.
    """
    before, least, latest, found = [0, *accumulate(i[2] for i in items)], 0, 0, set()
    for _ in range(shards):
        least = bisect_right(before, before[least] + low) - 1
        latest += high
        found.update(range(least, min(len(items), bisect_right(before, latest))))
    return [k for k in sorted(found) if items[k][3] > 1]


def cut_keys(groups: DataFrame, shards: int, most_items: int = 1 << RANGE_BITS) -> list[tuple[int, int]]:
    """First hash (k1, k2) of every shard after the first, for groups (k1, k2, bytes); reads at most twice ``most_items`` sums at a time."""
    bits = most_items.bit_length() - 1

    def summed(rows: DataFrame, shift: int) -> list[tuple]:
        got = rows.groupBy(F.shiftright("k1", shift).alias("part")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("most")).collect()
        return [(r["part"] << shift, -(1 << 63), r["b"], r["n"], r["most"], shift) for r in got]

    items = sorted(summed(groups, 64 - bits))
    if not items:
        return []
    total, most = sum(i[2] for i in items), max(i[4] for i in items)
    while True:
        high = smallest_capacity([i[2] for i in items], shards)
        inside = _open(items, shards, max(-(-total // shards), most), high)
        if not inside:
            break
        chosen = [items[k] for k in inside]
        where = F.lit(False)
        for shift in sorted({i[5] for i in chosen}):
            where = where | F.shiftright("k1", shift).isin([i[0] >> shift for i in chosen if i[5] == shift])
        rows, width = groups.where(where), max(i[5] for i in chosen)
        if sum(i[3] for i in chosen) <= most_items or not width:
            finer = [(r["k1"], r["k2"], r["bytes"], 1, r["bytes"], 0) for r in rows.collect()]
        else:
            finer = summed(rows, max(0, width - max(1, (most_items // len(inside)).bit_length() - 1)))
        gone = set(inside)
        items = sorted([i for k, i in enumerate(items) if k not in gone] + finer)
    ends = _cuts([i[2] for i in items], high, shards)
    return [items[e][:2] for e in ends if e < len(items)]


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for ``docs (doc_id, text)``."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *_key(text),
    )
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # at most shards - 1 groups can exceed an even share of the rest
    giants, left = [], total
    for g in groups.orderBy(F.desc("bytes"), "k1", "k2").limit(shards).collect():
        if len(giants) == shards - 1 or g["bytes"] * (shards - len(giants)) <= left:
            break
        giants.append((g["k1"], g["k2"]))
        left -= g["bytes"]
    own = lambda: [((F.col("k1") == a) & (F.col("k2") == b)) for a, b in giants]
    small = groups
    for condition in own():
        small = small.where(~condition)
    cuts = cut_keys(small, shards - len(giants))
    at = F.lit(len(giants))
    for a, b in cuts:
        at = at + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
    for i, condition in enumerate(own()):
        at = F.when(condition, i).otherwise(at)
    placed = rows.select("doc_id", "size", "text_crc32", at.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # at most shards x SLOT_BUCKETS rows
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    out = numbered.join(F.broadcast(offsets.select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))), ["shard", "bucket"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
