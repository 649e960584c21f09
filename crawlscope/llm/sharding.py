"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope.llm.common import numbered, stored

# Light groups are gathered into this many units by hash, and a group is packed by itself only if it is larger than a unit's
# fair share. So at most twice as many items are packed, whatever the number of rows.
UNITS = 16384


class RoomTree:
    """Balanced search tree (a treap) over (remaining room, bin): tightest bin with enough room in logarithmic time."""

    def __init__(self):
        self.root, self._seed = None, 1

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, bin_id: int) -> None:
        self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) % 2**64
        left, right = self._split(self.root, (room, bin_id))
        self.root = self._merge(self._merge(left, [(room, bin_id), self._seed >> 16, None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, which must be in falling order. A size above the capacity gets a bin of its own."""
    tree, bins, out = RoomTree(), 0, []
    for size in sizes:
        found = tree.take(size) if size <= capacity else None
        if found is None:
            room, bin_id = max(capacity, size), bins
            bins += 1
        else:
            room, bin_id = found
        tree.add(room - size, bin_id)
        out.append(bin_id)
    return out


def fewest_even(sizes: Sequence[int], shards: int) -> list[int]:
    """Bins 0..shards-1 of falling sizes: the smallest capacity for which best fit needs no more bins.

    A size above the fair share of what is left gets a bin of its own first, so one huge group does not widen the others.
    """
    alone, rest, left = 0, sum(sizes), shards
    while left > 1 and alone < len(sizes) and sizes[alone] * left > rest:
        rest, alone, left = rest - sizes[alone], alone + 1, left - 1
    tail = sizes[alone:]
    if not tail:
        return list(range(alone))
    low = max(-(-rest // left), tail[0])
    high, best = low, None
    while best is None:  # widen by growing steps until it fits, then halve the gap
        got = best_fit_decreasing(tail, high)
        if max(got) < left:
            best = got
        else:
            low, high = high + 1, high + max(1, (high - low + 1), high // 4096)
    while low < high and high - low > low // 100_000:
        middle = (low + high) // 2
        got = best_fit_decreasing(tail, middle)
        if max(got) < left:
            high, best = middle, got
        else:
            low = middle + 1
    return list(range(alone)) + [alone + b for b in best]


def _assigned(rows: DataFrame, group: Sequence[str], size: str, pack) -> DataFrame:
    """`rows` with `shard`. `pack` gets the falling item sizes on the driver: at most 2 * UNITS numbers."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy(*group).agg(F.sum(size).alias("_size")).withColumn("_unit", F.pmod(F.xxhash64(*group), F.lit(UNITS)).cast("int")))
    total = groups.agg(F.sum("_size")).first()[0] or 0
    heavy = groups.filter(F.col("_size") * UNITS > F.lit(total))
    light = groups.filter(F.col("_size") * UNITS <= F.lit(total)).groupBy("_unit").agg(F.sum("_size").alias("_size"))
    items = [(tuple(r[:-1]), r[-1]) for r in heavy.select(*group, "_size").collect()] + [((r[0],), r[1]) for r in light.collect()]
    items.sort(key=lambda x: (-x[1], len(x[0]), x[0]))
    bins = pack([s for _, s in items]) if items else []
    fields = [f for f in heavy.select(*group).schema.fields]
    heavy_bins = spark.createDataFrame([(*k, b) for (k, _), b in zip(items, bins, strict=True) if len(k) > 1], T.StructType([*fields, T.StructField("_heavy", T.IntegerType())]))
    unit_bins = spark.createDataFrame([(*k, b) for (k, _), b in zip(items, bins, strict=True) if len(k) == 1], "_unit int, _light int")
    # both sides have UNITS rows at most
    return (
        rows.withColumn("_unit", F.pmod(F.xxhash64(*group), F.lit(UNITS)).cast("int"))
        .join(F.broadcast(heavy_bins), list(group), "left").join(F.broadcast(unit_bins), "_unit", "left")
        .withColumn("shard", F.coalesce("_heavy", "_light").cast("int")).drop("_unit", "_heavy", "_light")
    )


def text_sizes(docs: DataFrame, text: str = "text", extra: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Size (UTF-8 bytes plus 1) and a 128-bit digest of the text in place of the text. Null counts as empty."""
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*extra, (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                       F.xxhash64(F.lit(1), whole).alias("_h1"), F.xxhash64(F.lit(2), whole).alias("_h2"))


def shard_evenly(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot (gapless from 0 in each shard), grown_shard (null).

    Equal texts stay together. Shards are as equal in bytes as whole groups allow. Null texts count as empty, repeated rows
    are rows of one group, an empty table gives an empty result; other columns are not read. Reruns agree.
    """
    placed = stored(_assigned(stored(text_sizes(docs)), ["_h1", "_h2"], "size", lambda sizes: fewest_even(sizes, shards)))
    out = numbered(placed.withColumn("law", F.lit("bytes")), ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_by_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, size, shard: as few shards of `capacity` bytes as best fit finds; a larger group has a shard of its own."""
    return _assigned(stored(text_sizes(docs)), ["_h1", "_h2"], "size", lambda sizes: best_fit_decreasing(sizes, capacity)).select("doc_id", "size", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write `docs` to one folder per shard, several files each."""
    where = shard_evenly(docs, shards).select("doc_id", "shard").distinct()
    docs.join(where, "doc_id").write.partitionBy("shard").parquet(path)
