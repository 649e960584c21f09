"""Merkle manifest of a dataset: one tree per key, a tree of their roots, and inclusion proofs for all rows.

A leaf is the SHA-256 of a row's columns. Proofs are made as multiproofs: a leaf partition works out the least set of nodes
that it cannot derive from its own leaves (the octopus walk), fetches those once, derives every interior node that its
leaves share, and then expands the proof of each leaf locally.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import stored
from crawlscope.skew import lookup_join

# A leaf partition holds 2^BITS consecutive leaves of one tree; nodes below its root are derived, never stored.
BITS = 10
# Rows that one task sorts on average.
PART_ROWS = 16_384
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
AT = ["_tree", "_group"]


def joined_hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns' values, each `-` where null and else its UTF-8 byte count, a colon and the value."""
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def depth_of(size: int) -> int:
    """Levels between the leaves and the root of a tree."""
    return max(0, int(size) - 1).bit_length()


# --- places of the leaves ------------------------------------------------------------------------------


def placed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """`rows` with the number `_tree` of their key (null first, then bytewise), their `_position` in it and its `_size`.

    Rows are range-partitioned and written in order with their place in the partition; the counts of the partitions before
    give the rest. No task holds a key's rows, and the tables of counts have one row per partition and key.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    line = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    line = stored(line.withColumn("_part", F.shiftright("_at", 33)))
    spans = line.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "_part", key, "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(of_key).alias("_size"),
        (F.min("_part").over(of_key) == F.col("_part")).alias("_begins"),
    )
    # keys are numbered by the partition they begin in: one row per partition goes through the undivided window
    begun = spans.filter("_begins").groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = begun.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_from"))
    trees = spans.filter("_begins").withColumn("_rank", rank).join(earlier, "_part").select(
        F.col(key).alias("_name"), (F.col("_earlier") + F.col("_rank") - 1).cast("long").alias("_tree"))
    spans = spans.join(trees, F.col(key).eqNullSafe(F.col("_name"))).select(
        F.col("_part").alias("_p"), F.col(key).alias("_k"), "_from", "_first", "_size", "_tree")
    place = (F.col("_first") + F.col("_at") - F.col("_from")).alias("_position")
    found = line.join(spans, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return found.select(*rows.columns, "_tree", place, "_size")


# --- nodes ---------------------------------------------------------------------------------------------


def _ascend(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes over consecutive nodes that begin at an even place on each level; a last lone one is hashed alone."""
    out = [digests]
    for _ in range(levels):
        d = out[-1]
        out.append([joined_hash(*d[i : i + 2]) for i in range(0, len(d), 2)])
    return out


def _above(level: int, whole: bool):
    """Nodes over one group of a level's nodes: all levels up to the group's root where `whole`, else that root alone."""
    def climb(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_position")
        size, tree = int(frame["_size"].iloc[0]), int(frame["_tree"].iloc[0])
        steps = min(BITS, depth_of(size) - level)
        over = _ascend(list(frame["_digest"]), steps)
        first = int(frame["_position"].iloc[0])
        kept = range(1, steps + 1) if whole else [steps]
        rows = [(tree, size, level + up, (first >> up) + i, d) for up in kept for i, d in enumerate(over[up])]
        return pd.DataFrame(rows, columns=["_tree", "_size", "_level", "_position", "_digest"])

    return climb


def nodes_above(leaves: DataFrame) -> DataFrame:
    """Nodes (_tree, _size, _level, _position, _digest) from the roots of the leaf partitions up to the root of each tree.

    A tier takes BITS levels at once, so a tree of 2^40 leaves takes four shuffles, each of 1/1024 of the rows before.
    """
    schema = "_tree long, _size long, _level int, _position long, _digest string"
    group = F.shiftright("_position", BITS).alias("_group")
    deepest = leaves.agg(F.max("_size")).first()[0]
    tier = stored(leaves.select("_tree", group, "_size", "_position", "_digest").groupBy(*AT).applyInPandas(_above(0, False), schema))
    tiers, level = [tier], BITS
    while level < depth_of(deepest or 0):
        lower = tier.filter(F.col("_level") == level).select("_tree", group, "_size", "_position", "_digest")
        tier = stored(lower.groupBy(*AT).applyInPandas(_above(level, True), schema))
        tiers.append(tier.filter(F.col("_level") > level))
        level += BITS
    nodes = tiers[0]
    for t in tiers[1:]:
        nodes = nodes.unionByName(t)
    return nodes


# --- proofs --------------------------------------------------------------------------------------------


def missing(positions: Sequence[int], size: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, position) which together with the leaves at `positions` gives the root of `size` leaves."""
    known, out, level = np.unique(np.asarray(positions, dtype=np.int64)), [], 0
    while size > 1 and len(known):
        beside = known ^ 1
        out += [(level, int(i)) for i in beside[(beside < size) & ~np.isin(beside, known)]]
        known, size, level = np.unique(known >> 1), (size + 1) // 2, level + 1
    return out


def _wanted(frames):
    for frame in frames:
        rows = [
            (int(tree), int(group), level, at)
            for tree, group, size, held in zip(frame["_tree"], frame["_group"], frame["_size"], frame["_held"])
            for level, at in missing(held, int(size))
        ]
        yield pd.DataFrame(rows, columns=[*AT, "_level", "_position"])


def fold(leaf: str, siblings: Sequence[str], sides: str) -> str:
    """The root that a leaf and its siblings give; a side is `L` or `R` (where the sibling stands) or `-` (there is none)."""
    rest = iter(siblings)
    for side in sides:
        leaf = joined_hash(leaf) if side == "-" else joined_hash(next(rest), leaf) if side == "L" else joined_hash(leaf, next(rest))
    return leaf


def _expand(held: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Proofs of one leaf partition from its leaves, the fetched nodes, and what leads from the tree's root on."""
    size = int(held["_size"].iloc[0])
    positions = [int(p) for p in held["_position"]]
    deep = depth_of(size)
    known: list[dict[int, str]] = [{} for _ in range(deep + 1)]
    known[0].update(zip(positions, held["_digest"]))
    top_proof, top_sides, root = "", "", None
    for level, at, digest, proof, sides in zip(*(fetched[c] for c in ("_level", "_position", "_digest", "_top", "_sides"))):
        if level < 0:
            top_proof, top_sides, root = proof, sides, digest
        else:
            known[int(level)][int(at)] = digest
    width = size
    for level in range(deep):  # interiors, each once for all leaves below
        here, over = known[level], known[level + 1]
        for i in {p >> 1 for p in here}:
            a, b = here.get(2 * i), here.get(2 * i + 1)
            if a is not None and (b is not None or 2 * i + 1 >= width):
                over[i] = joined_hash(a, b) if b is not None else joined_hash(a)
        width = (width + 1) // 2
    subroot = known[deep][0]
    above = [top_proof[i : i + 64] for i in range(0, len(top_proof), 64)]
    rows = []
    for p, claimed in zip(positions, held["_claimed"]):
        proof, sides, at = [], [], p
        for level in range(deep):
            sibling = known[level].get(at ^ 1)
            sides.append("-" if sibling is None else "L" if at & 1 else "R")
            if sibling is not None:
                proof.append(sibling)
            at >>= 1
        proof, sides = [*proof, *above], "".join(sides) + top_sides
        rows.append((subroot, subroot if root is None else root, "".join(proof), sides, fold(claimed, proof, sides)))
    out = held.drop(columns=["_size", "_claimed", *AT])
    out[["_subroot", "_root", "_proof", "_sides", "_folded"]] = pd.DataFrame(rows, index=out.index, columns=list("srpdf"))
    return out.rename(columns={"_digest": "_leaf"})


def proofs(leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Leaves (_tree, _position, _size, _digest, _claimed, and columns to keep) with `_leaf`, `_subroot`, `_root`, `_proof`
    (siblings from the leaf upward, 64 digits each), `_sides` (see `fold`) and `_folded`, the root that `_claimed` leads to.

    `above` (_tree, _top, _sides, _digest) continues a tree's proofs to a common root. Nodes near a root are asked for by
    very many leaf partitions; the 1000 most wanted come from a broadcast of exactly so many rows.
    """
    held = leaves.withColumn("_group", F.shiftright("_position", BITS))
    groups = held.groupBy(*AT).agg(F.first("_size").alias("_size"), F.collect_list("_position").alias("_held"))
    wanted = groups.mapInPandas(_wanted, "_tree long, _group long, _level int, _position long")
    asked = nodes.withColumn("_asks", F.expr(f"shiftleft(1L, _level - {BITS})")).select("_tree", "_level", "_position", "_digest", "_asks")
    nothing = F.lit(None).cast("string")
    fetched = lookup_join(wanted, asked, ["_tree", "_level", "_position"], weight="_asks", how="inner").withColumns({"_top": nothing, "_sides": nothing})
    if above is not None:
        each = held.groupBy(*AT).agg(F.first("_size").alias("_size")).select(*AT)
        tops = above.select("_tree", "_digest", "_top", "_sides", "_size")
        further = lookup_join(each, tops, ["_tree"], weight="_size", how="inner")
        fetched = fetched.unionByName(further.withColumns({"_level": F.lit(-1), "_position": F.lit(0).cast("long")}).select(*fetched.columns))
    kept = [f for f in leaves.schema.fields if f.name not in ("_size", "_claimed", "_tree", "_digest")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{c} string" for c in ("_leaf", "_subroot", "_root", "_proof", "_sides", "_folded")]])
    names = [*[f.name for f in kept], "_leaf", "_subroot", "_root", "_proof", "_sides", "_folded"]

    def expand(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=names)
        return _expand(a, b)[names]

    return held.groupBy(*AT).cogroup(fetched.groupBy(*AT)).applyInPandas(expand, schema)


def manifest(
    docs: DataFrame, claims: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, key: str = "lang", order: str = "doc_id",
) -> DataFrame:
    """Per row of `docs`: its `order` and `key` columns, leaf, subroot (of its key's tree), root, proof, sides and, for the
    values in `claims` put in place of the columns they name, folded_root (recomputed with the original siblings) and verified.

    Nulls anywhere have an own form in the leaf; null keys make a tree of their own, which is the first. Rows of one
    `order` value stand by leaf, so repeated rows (equal leaves) may change places without changing anything. A tree of one leaf
    has that leaf as its root, and a lone tree's root is the root: both have no siblings, and an empty proof. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    claims = claims or {}
    rows = stored(docs.select(
        F.col(order).alias("_order"), F.col(key).alias("_key"), leaf_hash([F.col(c) for c in columns]).alias("_digest"),
        leaf_hash([claims.get(c, F.col(c)) for c in columns]).alias("_claimed")))
    leaves = stored(placed(rows, "_key", ["_order", "_digest"]))
    nodes = nodes_above(leaves)
    # a tree's number is its place among the subroots; trees of more than one row are met by their top node alone
    tops = nodes.groupBy("_tree").agg(F.max_by("_digest", "_level").alias("_digest"), F.first("_size").alias("_count"))
    count = tops.count()
    subroots = stored(tops.select(
        F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_position"), F.lit(count).cast("long").alias("_size"), "_digest",
        F.col("_digest").alias("_claimed"), "_count"))
    above = proofs(subroots, nodes_above(subroots)).select(
        F.col("_position").alias("_tree"), F.col("_root").alias("_digest"), F.col("_proof").alias("_top"), "_sides", F.col("_count").alias("_size"))
    out = proofs(leaves, nodes, stored(above))
    return out.select(
        F.col("_order").alias(order), F.col("_key").alias(key), F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"), F.col("_proof").alias("proof"), F.col("_sides").alias("sides"), F.col("_folded").alias("folded_root"),
        (F.col("_folded") == F.col("_root")).alias("verified"))
