"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import numbered, stored, word_count

# Sources in code-point order weigh these, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
# Newton steps at most; a step outside its bracket halves the bracket instead.
STEPS = 60
# Words by which a source may miss its target before rounding, relative to the target.
TOLERANCE = 1e-10


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source (`source`, `key`, `source_size`) with `target`: `share` of all words by weight, none above `cap` times its size.

    The level at which sources stop is found in one pass: in order of cap * size / weight, the first source that the
    remaining words do not fill marks it. Works on one row per source.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    by_ratio = Window.partitionBy().orderBy("ratio", "key")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = (
        weighed.withColumn("full", F.col("source_size") * float(cap)).withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return found.select("source", "key", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("weight"), "full")).alias("target"))


def rates(classes: DataFrame, aims: DataFrame, cap: float = CAP) -> DataFrame:
    """`classes` (key, size, n) with `rate`: least(cap, exp(dual * size / mean)), the tilt that meets each source's target.

    The dual is convex and splits by source; each Newton step sums the tilted words and their slope over the classes,
    and all sources step together. Sources whose target is all they may give are filled at once.
    """
    shape = classes.filter("size > 0").groupBy("key").agg(
        F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean"))
    ratio = F.col("target") / F.col("source_size")
    lowest = F.col("mean") / F.col("least")
    state = stored(
        aims.join(shape, "key").withColumn("full", F.col("target") >= F.col("source_size") * cap * (1 - 1e-12))
        .select("key", "target", "mean", "full", F.log(ratio).alias("dual"),
                F.least(F.log(ratio), F.lit(0.0)).alias("low") * lowest, (F.log(F.lit(float(cap))) * lowest).alias("high"))
        .toDF("key", "target", "mean", "full", "dual", "low", "high")
    )
    tilt = F.least(F.lit(float(cap)), F.exp(F.col("dual") * F.col("size") / F.col("mean")))
    for _ in range(STEPS):
        words = F.col("n") * F.col("size") * F.col("_r")
        slope = F.when(F.col("_r") < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            classes.filter("size > 0").join(state, "key").withColumn("_r", tilt)
            .groupBy("key").agg(F.sum(words).alias("_got"), F.sum(slope).alias("_slope"))
        )
        miss = F.col("_got") - F.col("target")
        low = F.when(miss <= 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("dual")).otherwise(F.col("high"))
        step = F.col("dual") - miss / F.col("_slope")
        state = stored(
            state.join(sums, "key").withColumns({"low": low, "high": high, "_step": step, "_miss": F.abs(miss) / F.col("target")})
            .withColumn("_done", F.col("full") | (F.col("_miss") <= TOLERANCE) | (F.col("high") - F.col("low") <= 1e-15))
            .withColumn("dual", F.when(F.col("_done"), F.col("dual"))
                        .when((F.col("_step") > F.col("low")) & (F.col("_step") < F.col("high")), F.col("_step"))
                        .otherwise((F.col("low") + F.col("high")) / 2))
            .select("key", "target", "mean", "full", "dual", "low", "high", "_done")
        )
        if state.filter("NOT _done").limit(1).count() == 0:
            break
        state = state.drop("_done")
    else:
        raise RuntimeError(f"the dual is not solved after {STEPS} steps")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(tilt)
    return classes.join(state, "key", "left").select("key", "size", "n", F.coalesce(rate, F.lit(1.0)).alias("rate"))


def class_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies for each (key, size): the wanted words of the classes, large sizes first, with the rounding error carried on.

    One row holds a source's distinct sizes, as many as its longest document has words at most, whatever the number of rows.
    """
    item = "struct<s:bigint,n:bigint,r:double>"
    lists = rated.filter("size > 0").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("size").alias("s"), F.col("n").cast("long").alias("n"), F.col("rate").alias("r"))), asc=False).cast(f"array<{item}>").alias("items"))

    def add(state, x):
        wanted = state["carry"] + x["n"] * x["s"] * x["r"]
        copies = F.least(x["n"] * cap, F.greatest(F.lit(0), F.round(wanted / x["s"]))).cast("long")
        return F.struct((wanted - copies * x["s"]).cast("double").alias("carry"), F.concat(state["out"], F.array(copies)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("out"))
    dealt = lists.select("key", F.arrays_zip(F.col("items.s").alias("size"), F.aggregate("items", start, add)["out"].alias("copies")).alias("z"))
    some = dealt.select("key", F.explode("z").alias("z")).select("key", "z.*").toDF("key", "size", "copies")
    return some.unionByName(rated.filter("size = 0").select("key", "size", F.col("n").cast("long").alias("copies")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies (0 to `cap`), taken = size * copies.

    Sizes are words of the whole text; a null or empty text has none and is kept once. Null is a source of its own, ordered last.
    Within a source, documents of one size differ by one copy at most; the hash of doc_id decides which, so reruns agree.
    Repeated rows are rows like others. Empty tables give empty results. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("!"))
    sized = stored(docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size")))
    classes = stored(sized.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = classes.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = stored(targets(sizes, weights, share, cap))
    dealt = class_copies(rates(classes.select("key", "size", "n"), aims, cap), cap)
    dealt = dealt.join(classes.select("key", "size", "n"), ["key", "size"]).join(aims.select("key", "source_size", "target"), "key")
    placed = numbered(sized, ["key", "size"], [F.col("doc_id")], "_at")
    # the hash makes both sides meet by a fresh shuffle, which run-time splitting may cut where one class is heavy
    hashed = lambda df: df.withColumn("_h", F.xxhash64("key", "size"))
    base = F.floor(F.col("copies") / F.col("n"))
    copies = (base + F.when(F.col("_at") < F.col("copies") - base * F.col("n"), 1).otherwise(0)).cast("int")
    return (
        hashed(placed).join(hashed(dealt), ["key", "size", "_h"]).withColumn("_copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("size") * F.col("_copies")).alias("taken"))
    )


def resample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix` takes it. Rows that share a doc_id, source and size share the larger count."""
    counts = mix(docs, **options).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("_copies"))
    taken = counts.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_copies")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (word_count(F.col("text")) == F.col("_z"))
    return docs.join(taken, on).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
