"""Building blocks that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A hot side holds at most this many keys, so broadcasting it is bounded whatever the data.
# Every key outside it then holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
# Parts into which the rows of a key are dealt before its first rows are picked.
PARTS = 64


def lookup_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], weight: str | None = None, how: str = "left", hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Attach the columns of `dim` (at most one row per key) to `facts`, however uneven the keys are.

    Left to itself, the join is sized while it runs: a side that turns out small is broadcast, and beyond
    that the partitions of heavy keys are split (see `session.RUNTIME_SETTINGS`). No side is broadcast unseen.

    Where `dim` comes with the number of fact rows per key, named by `weight`, the heaviest `hot_keys` keys
    are instead answered from a broadcast of exactly that many rows. Rows so answered leave at once, where they
    lie; only the others are shuffled, and none of their keys is heavy. That holds without run-time splitting too.
    `how` is left, inner, left_semi or left_anti.
    """
    keys = list(keys)
    values = [c for c in dim.columns if c not in keys and c != weight]
    wanted = [F.col(c) for c in facts.columns] + [F.col(c) for c in values if how in ("left", "inner")]
    if weight is None:
        # A side aggregated by the same keys would be joined where it lies, and then nothing can be split:
        # with the hash as a further key both sides are shuffled for the join.
        key_hash = F.xxhash64(*keys)
        sides = facts.withColumn("_key_hash", key_hash), dim.withColumn("_key_hash", key_hash)
        return sides[0].join(sides[1], [*keys, "_key_hash"], how).select(*wanted)
    answered, rest = _by_hot_keys(facts, dim, keys, values, weight, hot_keys)
    # estimates from the size of a small file would broadcast even millions of rows
    cold = rest.join(dim.select(*keys, *values).hint("merge"), keys, how).select(*wanted)
    if how == "left_anti":
        return cold
    return answered.select(*[F.col(c) for c in facts.columns], *[F.col(f"_hot.{c}").alias(c) for c in values if how in ("left", "inner")]).unionByName(cold)


def _by_hot_keys(
    facts: DataFrame, dim: DataFrame, keys: list[str], values: list[str], weight: str, hot_keys: int
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the heaviest, with that key's values as `_hot`, and the rest as it came."""
    packed = F.struct(F.lit(True).alias("_found"), *[F.col(c) for c in values])
    hot = dim.orderBy(F.col(weight).desc_nulls_last(), *keys).limit(hot_keys).select(*keys, packed.alias("_hot"))
    step = facts.join(F.broadcast(hot), keys, "left")
    return step.filter(F.col("_hot").isNotNull()), step.filter(F.col("_hot").isNull()).select(*facts.columns)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first `k` rows per key, in two steps: of each of a key's PARTS parts, then of what these leave.

    No task sorts all rows of a key; the second step meets k * PARTS of them at most.
    """
    hashable = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in hashable]), F.lit(PARTS)))
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    few = dealt.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= k).drop(rank, "_part")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def sample_text(
    df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[Column], k: int, name: str, separator: str = ", "
) -> DataFrame:
    """One joined text of the first `k` values per key; the collected lists never exceed k."""
    picked = first_k(df.withColumn("_text", text), keys, order, k)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "_text")))
    return picked.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda x: x["_text"]), separator).alias(name)
    )


def counted_sample(
    df: DataFrame,
    keys: Sequence[str],
    text: Column,
    order: Sequence[Column],
    k: int = 5,
    separator: str = ", ",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per key: the number of rows `n`, further aggregates, and `sample`, the first k texts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra)
    return counts.join(sample_text(df, keys, text, order, k, "sample", separator), list(keys), "left")


def latest_rows(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All rows carrying the newest `date` of their key.

    Older rows of the heaviest keys go where they lie; the others meet their key's newest date by key and date, so no
    key's history is gathered.
    """
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(date).alias("_newest"), F.count(F.lit(1)).alias("_n"))
    answered, rest = _by_hot_keys(df, newest, keys, ["_newest"], "_n", HOT_KEYS)
    kept = answered.filter(F.col(date) == F.col("_hot._newest")).select(*df.columns)
    cold = newest.select(*keys, F.col("_newest").alias(date))
    return kept.unionByName(rest.join(cold, [*keys, date], "left_semi").select(*df.columns))


@dataclass(frozen=True)
class Newest:
    """Rows that are known to be the newest of their keys, so that no operator looks for these again."""

    rows: DataFrame

    def current(self) -> DataFrame:
        return self.rows
