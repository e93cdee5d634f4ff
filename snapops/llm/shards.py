"""Sharding by longest processing time first, on groups that must stay together.

Equal texts are one group. A group of more than 1/4,096 of all bytes is an item of its own,
so there are at most 4,096 such items at any size of the input; all other groups fall by
their hash into 4,096 large and 4,096 small bins, which are items too. Items sorted by size
go to the least loaded shard through a heap: the small bins come last and level the shards.
Only the items' sizes reach the driver; their number does not depend on the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import numbered, saved

ITEMS = 4096
#: One hash value in so many goes to a small bin.
SMALL = 16


def longest_first(items: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """``(name, size)`` items to the shard each one goes to; ties by name and shard number."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def _bin(group):
    """Large bins are 0 to 4,095, small ones follow."""
    small = F.pmod(group, F.lit(SMALL)) == 0
    spread = F.pmod(F.shiftrightunsigned(group, 20), F.lit(ITEMS))
    return (spread + F.when(small, F.lit(ITEMS)).otherwise(F.lit(0))).cast("long")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``; these replace columns of the same names.

    A row's size is the UTF-8 length of its text plus one. Slots count 0, 1, 2, ... within a
    shard. Defined cases: null texts are one group of size one a row, without a checksum; the
    empty text is a group too; repeated rows are one group and get different slots; rows with
    a null id are placed like any other; an empty table gives an empty result.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in docs.columns if c.lower() not in added]
    text = F.col("text").cast("string")
    sized = docs.select(*kept, (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text"))
    groups = saved(sized.groupBy("__text").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_big = F.col("bytes") * ITEMS > F.lit(total).cast("decimal(38,0)")
    spark = docs.sparkSession
    big = {r[0]: r[1] for r in groups.where(is_big).collect()}  # at most 4,096 rows, as their bytes sum to no more than the total
    bins = {r[0]: r[1] for r in groups.where(~is_big).groupBy(_bin(F.col("__text")).alias("bin")).agg(F.sum("bytes")).collect()}  # at most 8,192
    placed = longest_first([((0, n), s) for n, s in big.items()] + [((1, n), s) for n, s in bins.items()], shards)
    own = spark.createDataFrame([(n, s) for (kind, n), s in placed.items() if kind == 0], "__group long, __own int")
    binned = spark.createDataFrame([(n, s) for (kind, n), s in placed.items() if kind == 1], "__bin long, __shared int")
    where = sized.join(F.broadcast(own), sized["__text"] == own["__group"], "left").withColumn("__of", _bin(F.col("__text"))).join(F.broadcast(binned), F.col("__of") == binned["__bin"], "left")
    shard = where.select(*kept, "size", "text_crc32", F.coalesce("__own", "__shared").alias("shard"))
    return numbered(shard, "shard", [F.col("doc_id"), F.col("text_crc32")], "slot")
