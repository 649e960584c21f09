"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import components, numbered, stored

THRESHOLD = 0.9
# Neighbours kept per vector, and the best reverse ones that meet them; lists full of links are enlarged by WIDER.
LIST, WIDER = 10, 4
# Random orders in which each vector first meets NEAR others on either side; every one splits at about LEAF vectors.
TABLES, LEAF, NEAR, FIRST = 8, 48, 8, 3
ROUNDS, AGAIN = 6, 3
# Vectors whose id is divisible by AUDIT are compared with all others; the mean share of found links, of vectors with up to LIST
# links and of those with more apart, must reach RECALL.
AUDIT, RECALL = 100, 0.98
BLOCK = 512


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pieces(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of a sorted stream, one at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        bounds = [0, *cuts.tolist(), len(frame)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(frame.iloc[a:b])
            if b < len(frame):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _first_lists(nodes: DataFrame, n: int, seed: int, width: int) -> DataFrame:
    """(src, dst, sim): in each table vectors are keyed by the sides of random planes they lie on and meet their neighbours along one line."""
    bits = max(0, int(math.log2(max(1, n / LEAF))))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        planes, lines = rng.normal(size=(TABLES, bits, width)), rng.normal(size=(TABLES, width))
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["x"])
            for t in range(TABLES):
                side = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"key": side * TABLES + t, "line": x @ lines[t], "node": frame["node"], "x": frame["x"]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None
        for frame in frames:
            if tail is not None:
                frame = pd.concat([tail, frame], ignore_index=True)
            if len(frame) < 2:
                tail = frame if len(frame) else tail
                continue
            x, key, node = _matrix(frame["x"]), frame["key"].to_numpy(), frame["node"].to_numpy()
            sims = np.full((len(x), 2 * NEAR), -2.0)
            other = np.zeros((len(x), 2 * NEAR), np.int64)
            for g in range(1, min(NEAR, len(x) - 1) + 1):
                s = np.where(key[g:] == key[:-g], np.einsum("ij,ij->i", x[g:], x[:-g]), -2.0)
                sims[:-g, g - 1], sims[g:, NEAR + g - 1] = s, s
                other[:-g, g - 1], other[g:, NEAR + g - 1] = node[g:], node[:-g]
            best = np.argsort(-sims, axis=1, kind="stable")[:, :FIRST]
            s = np.take_along_axis(sims, best, axis=1).ravel()
            ok = s > -2
            yield pd.DataFrame({"src": np.repeat(node, FIRST)[ok], "dst": np.take_along_axis(other, best, axis=1).ravel()[ok], "sim": s[ok]})
            tail = frame.iloc[-NEAR:]

    near = nodes.select("node", "x").mapInPandas(keyed, "key long, line double, node long, x array<float>")
    return near.repartition("key").sortWithinPartitions("key", "line", "node").mapInPandas(meet, "src long, dst long, sim double")


def _best(edges: DataFrame, k: int | str = LIST) -> DataFrame:
    """The k best of each list. `edges` may say the same link twice."""
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst"))
    return one.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def _refined(graph: DataFrame, nodes: DataFrame, k: int, centres: DataFrame | None = None) -> DataFrame:
    """(src, dst, sim) better than the lists hold: at each centre its neighbours, best reverse neighbours and itself meet."""
    out = graph.select(F.col("src").alias("centre"), F.col("dst").alias("member"), "sim", "fresh")
    back = graph.select(F.col("dst").alias("centre"), F.col("src").alias("member"), "sim", "fresh")
    back = back.withColumn("_r", F.row_number().over(Window.partitionBy("centre").orderBy(F.col("sim").desc(), "member"))).filter(F.col("_r") <= k).drop("_r")
    met = out.unionByName(back).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    alive = met.groupBy("centre").agg(F.max("fresh").alias("any")).filter("any > 0").select("centre")
    if centres is not None:
        alive = alive.join(centres, "centre", "left_semi")
    own = alive.select("centre", F.col("centre").alias("member"), F.lit(0).alias("fresh"))
    met = met.join(alive, "centre", "left_semi").unionByName(own)
    worst = graph.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_s")).select(F.col("src").alias("_m"), F.when(F.col("_n") >= k, F.col("_s")).otherwise(-2.0).alias("worst"))
    known = met.join(nodes.select(F.col("node").alias("member"), "x"), "member").join(worst, F.col("member") == F.col("_m"), "left").drop("_m")
    known = known.withColumn("worst", F.coalesce("worst", F.lit(-2.0)))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst, sims, held = [], [], [], 0
        for group in _pieces(frames, ["centre"]):
            if len(group) < 2:
                continue
            x, node, worst, fresh = _matrix(group["x"]), group["member"].to_numpy(), group["worst"].to_numpy(), group["fresh"].to_numpy() > 0
            s = x @ x.T
            # pairs that met before, both old, need no second look
            better = (s > worst[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(better, False)
            a, b = np.nonzero(better)
            src.append(node[a]), dst.append(node[b]), sims.append(s[a, b])
            held += len(a)
            if held > 200_000:
                yield _unique(src, dst, sims)
                src, dst, sims, held = [], [], [], 0
        if held:
            yield _unique(src, dst, sims)

    return known.repartition("centre").sortWithinPartitions("centre", "member").mapInPandas(meet, "src long, dst long, sim double")


def _unique(src: list, dst: list, sims: list) -> pd.DataFrame:
    return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "sim": np.concatenate(sims)}).drop_duplicates(["src", "dst"])


def _descend(graph: DataFrame, nodes: DataFrame, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """Refine until a round finds less than a thousandth more links, and hardly any for vectors whose lists still have room."""
    links = graph.filter(F.col("sim") >= threshold).count()
    for turn in range(rounds):
        found = _refined(graph, nodes, LIST).select("src", "dst", "sim", F.lit(1).alias("fresh"))
        # what a list already held stays old
        graph = stored(_best(graph.withColumn("fresh", F.lit(0)).unionByName(found)))
        now = graph.filter(F.col("sim") >= threshold).count()
        # a dense group's many links say nothing about vectors with few
        few = graph.filter(F.col("sim") >= threshold).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("new")).filter(F.col("n") < LIST)
        small = few.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("new") > 0).alias("grown")).first()
        if turn > 0 and now - links <= links // 1000 and small["grown"] <= small["all"] // 1000:
            break
        links = now
    return graph


def _audited(nodes: DataFrame, n: int, threshold: float, every: int) -> DataFrame:
    """(src, dst, sim): all links of the vectors whose id is divisible by `every`, each block of rows against all of these in turn."""
    blocks = max(1, -(-n // 8192))
    asked = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "node", "x")
    asking = nodes.filter(F.col("node") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "node", "x")

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, x, ids = None, [], None, None
        for frame in frames:
            for (at, asks), some in frame.groupby(["block", "asks"], sort=True):
                if at != block:
                    block, held, x = at, [], None
                if not asks:
                    held.append(some)
                    continue
                if x is None and held:
                    mine = pd.concat(held, ignore_index=True)
                    x, ids = _matrix(mine["x"]), mine["node"].to_numpy()
                if x is None:
                    continue
                for i in range(0, len(some), 256):
                    q, q_ids = _matrix(some["x"].iloc[i : i + 256]), some["node"].to_numpy()[i : i + 256]
                    s = q @ x.T
                    a, b = np.nonzero(s >= threshold)
                    other = q_ids[a] != ids[b]
                    yield pd.DataFrame({"src": q_ids[a][other], "dst": ids[b][other], "sim": s[a, b][other]})

    met = asked.unionByName(asking).repartition(max(blocks, 1), "block").sortWithinPartitions("block", "asks")
    return met.mapInPandas(visit, "src long, dst long, sim double")


def _recall(truth: DataFrame, label: DataFrame) -> float:
    """The mean, over audited vectors, of the share of their true links found; the lower one of vectors with few and with many links.

    A true link counts as found where both ends have come into one component, in which all links are counted.
    """
    ends = truth.join(label.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src", "left").join(label.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst", "left")
    each = ends.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c1") == F.col("c2")).alias("hit"))
    told = each.groupBy(F.col("n") > LIST).agg(F.avg(F.col("hit") / F.col("n")).alias("r")).collect()
    return min((row["r"] for row in told), default=1.0)


def _joined(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix: the smallest row that links reach; columns without links have the number of rows."""
    left, right = np.arange(len(linked)), np.full(linked.shape[1], len(linked))
    a, b = np.nonzero(linked)
    while True:
        before = left.copy()
        np.minimum.at(right, b, left[a])
        np.minimum.at(left, a, right[b])
        left = left[left]
        if (left == before).all():
            return left, right


def _all_joined(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): pairs that hold all vectors together which links join, from an exact comparison of every block with every other; no more
    pairs leave a task than it has rows."""
    blocks = max(1, -(-n // BLOCK))
    placed = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("mine"), "node", "x")
    pairs = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("mine", "_o").alias("low"), F.greatest("mine", "_o").alias("high"), "mine", "node", "x")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _pieces(frames, ["low", "high"]):
            left, right = group[group["mine"] == group["low"]], group[group["mine"] == group["high"]]
            if not len(left) or not len(right):
                continue
            first, second = _joined(_matrix(left["x"]) @ _matrix(right["x"]).T >= threshold)
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            some = second < len(a)
            pair = pd.DataFrame({"a": np.concatenate([a[first], a[second[some]]]), "b": np.concatenate([a, b[some]])})
            yield pair[pair["a"] != pair["b"]]

    met = pairs.repartition("low", "high").sortWithinPartitions("low", "high", "node")
    return met.mapInPandas(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _link_counts(nodes: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(node, links): vectors linked with each within its component, every block of members against every other; only counts leave a task."""
    placed = stored(numbered(label.join(nodes, "node"), ["component"], [F.col("node")], "_at").withColumn("_b", (F.col("_at") / BLOCK).cast("int")))
    blocks = placed.groupBy("component").agg((F.max("_b") + 1).alias("_blocks"))
    pairs = (
        placed.withColumn("_h", F.xxhash64("component")).join(blocks.withColumn("_h", F.xxhash64("component")), ["component", "_h"])
        .withColumn("_o", F.explode(F.expr("sequence(0, _blocks - 1)")))
        .select("component", F.least("_b", "_o").alias("low"), F.greatest("_b", "_o").alias("high"), F.col("_b").alias("mine"), "node", "m", "x")
    )

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes_, links, held = [], [], 0
        for group in _pieces(frames, ["component", "low", "high"]):
            left = group[group["mine"] == group["low"]]
            right = group[group["mine"] == group["high"]]
            if not len(left) or not len(right):
                continue
            linked = _matrix(left["x"]) @ _matrix(right["x"]).T >= threshold
            if group["low"].iloc[0] == group["high"].iloc[0]:
                np.fill_diagonal(linked, False)
                nodes_.append(left["node"].to_numpy()), links.append(linked @ right["m"].to_numpy())
            else:
                nodes_ += [left["node"].to_numpy(), right["node"].to_numpy()]
                links += [linked @ right["m"].to_numpy(), linked.T @ left["m"].to_numpy()]
            held += len(group)
            if held > 50_000:
                yield pd.DataFrame({"node": np.concatenate(nodes_), "links": np.concatenate(links)})
                nodes_, links, held = [], [], 0
        if held:
            yield pd.DataFrame({"node": np.concatenate(nodes_), "links": np.concatenate(links)})

    met = pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
    return met.mapInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding", seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall for every row of `vectors`.

    Two vectors link when their cosine, in double precision, reaches `threshold`. Null and zero vectors, and those that hold
    a null or non-finite component, link with nothing; so do vectors of another length than the commonest smallest length.
    component_id is the smallest id reachable by links, kept tells whether it is the row's own. Rows with a null id are
    returned without links. Repeated ids count as copies. An empty table gives an empty result; other columns are not read.

    Equal vectors are one node. Lists start from neighbours along random lines, then descend. Full lists of links are
    enlarged: their owners meet all neighbours of neighbours with lists WIDER times as long. An audit compares a stated
    share of the vectors with all; below RECALL the descent starts again from new lines, and the audit's own links are
    kept. If it stays below, every block of vectors is compared with every other, which misses nothing. Within the components so found all links are counted block by block, so n_links is exact there.
    """
    sound = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, F.col(vector)).cast("array<float>").alias("x"))
    width = rows.filter("x IS NOT NULL").groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = width[0]["w"] if width else 0
    usable = F.col("x").isNotNull() & (F.size("x") == width)
    named = rows.withColumns({"h1": F.when(usable, F.xxhash64(F.lit(1), "x")), "h2": F.when(usable, F.xxhash64(F.lit(2), "x"))})
    nodes = stored(named.filter(usable).groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("x").alias("x")))
    n = nodes.count()
    flat = nodes.select("node", "m", "x")
    graph, recall = None, 1.0
    truth = stored(_audited(flat, n, threshold, AUDIT))
    for attempt in range(AGAIN):
        found = _first_lists(flat, n, seed + attempt, width).withColumn("fresh", F.lit(1))
        if graph is not None:
            found = found.unionByName(graph.withColumn("fresh", F.lit(0)))
        graph = _descend(stored(_best(found)), flat, threshold)
        links = graph.filter(F.col("sim") >= threshold).select("src", "dst")
        full = graph.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_s")).filter((F.col("_n") >= LIST) & (F.col("_s") >= threshold)).select(F.col("src").alias("centre"))
        full = stored(full)
        if full.limit(1).count():
            wide = graph.join(full.select(F.col("centre").alias("src")), "src", "left_semi").withColumn("fresh", F.lit(1))
            more = _refined(wide, flat, LIST * WIDER, full).filter(F.col("sim") >= threshold).withColumn("fresh", F.lit(0))
            links = links.unionByName(_best(more.unionByName(wide), LIST * WIDER).filter(F.col("sim") >= threshold).select("src", "dst"))
        links = stored(links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
        label = components(links)
        recall = _recall(truth, label)
        if recall >= RECALL:
            break
    else:
        links = stored(links.unionByName(_all_joined(flat, n, threshold)).distinct())
        recall = _recall(truth, components(links))
    missing = truth.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    label = stored(components(links.unionByName(missing).distinct()))
    counts = _link_counts(flat, label, threshold)
    known = nodes.select("h1", "h2", "node", "m").join(label, "node", "left").join(counts, "node", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"), F.xxhash64("h1", "h2").alias("_h"))
    # the hash as a further key lets run-time splitting cut a vector with very many copies
    out = named.withColumn("_h", F.xxhash64("h1", "h2")).join(known, ["h1", "h2", "_h"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
