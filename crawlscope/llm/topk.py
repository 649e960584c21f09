"""Exact top-k by inner product with sequential access only: no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import stored

# Rows whose sorted lists are read together, and queries that read them together: a task holds one block of each.
BLOCK = 8192
QUERY_BLOCK = 256
# Depths of the lists, as parts of their length, at which bounds are compared.
DEPTHS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """Place of every row in each dimension's list, greatest component first."""
    order = np.argsort(-x, axis=0, kind="stable")
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.arange(len(x))[:, None], axis=0)
    return places


def no_random_access(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): the k greatest inner products over rows `x`, ties to smaller ids, own id left out.

    A dimension's list is read from its greatest component down where the query is positive, from its smallest up where it
    is negative. What has been read sums to a row's known score; the parts not yet read are bounded above by the last value
    read and below by the list's far end. Once fewer than all rows can still reach the k-th best lower bound,
    only they are kept; when no outsider qualifies, the remaining parts of the kept rows are read to resolve their scores.
    """
    n = len(x)
    places = sorted_lists(x)
    ranked = -np.sort(-x, axis=0)
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    live = np.arange(len(queries))
    for part in DEPTHS:
        depth = min(n, max(k + 1, int(np.ceil(n * part))))
        top, bottom = places < depth, places >= n - depth
        known = up[live] @ np.where(top, x, 0.0).T + down[live] @ np.where(bottom, x, 0.0).T
        # lists not yet read for a row: the last value read bounds it above, the far end below
        a, b = up[live], down[live]
        upper = known + (a * ranked[depth - 1]) @ (~top).T + (b * ranked[n - depth]) @ (~bottom).T
        lower = known + (a * ranked[-1]) @ (~top).T + (b * ranked[0]) @ (~bottom).T
        own = ids[None, :] == query_ids[live][:, None]
        lower[own], upper[own] = -np.inf, -np.inf
        keep = min(k, n)
        kth = np.partition(lower, n - keep, axis=1)[:, n - keep]
        qualify = (upper >= kth[:, None]) & ~own
        done = (qualify.sum(axis=1) <= 4 * k) | (depth == n)
        for at in np.flatnonzero(done):
            rows = np.flatnonzero(qualify[at])
            scores = x[rows] @ queries[live[at]]
            best = np.lexsort((ids[rows], -scores))[:k]
            yield live[at], ids[rows][best], scores[best]
        live = live[~done]
        if not len(live):
            return


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = vectors.map(len).max()
    if (vectors.map(len) == width).all():
        return np.stack(vectors.to_numpy()).astype(float).reshape(len(vectors), width)
    return np.stack([_wide(np.asarray(v, float)[None, :], width)[0] for v in vectors])


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def inner_product_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best rows for each query (id divisible by `every`), the query's own id left out.

    Components become floor(scale * x). Rows whose id or vector is null, or whose vector holds a null or a non-finite
    component, take no part; vectors of different lengths are compared as if padded with zeros.
    Ties go to the smaller id. Repeated ids are rows of their own. With no queries or no rows the result is empty; other
    columns are not read. Scores must stay below 2**53, up to which they are exact.

    Rows are hashed to blocks, and every query visits every block, reads that block's lists and sends on k rows. A task
    holds one block and QUERY_BLOCK queries, so memory is bounded; only queries are repeated, once per block.
    """
    sound = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = stored(vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("x")))
    n = rows.count()
    blocks = max(1, -(-n // block))
    place = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = rows.select(place.alias("block"), F.lit(0).alias("asks"), "id", "x")
    asking = rows.filter(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "x")

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by block, rows before queries: the block's rows are held, its queries pass by."""
        block, held, x, ids = None, [], None, None
        for frame in frames:
            for (at, asks), some in frame.groupby(["block", "asks"], sort=True):
                if at != block:
                    block, held, x = at, [], None
                if not asks:
                    held.append(some)
                    continue
                if x is None:
                    if not held:
                        continue
                    mine = pd.concat(held, ignore_index=True)
                    x, ids = _matrix(mine["x"]), mine["id"].to_numpy(np.int64)
                for start in range(0, len(some), QUERY_BLOCK):
                    part = some.iloc[start : start + QUERY_BLOCK]
                    part_ids, q = part["id"].to_numpy(np.int64), _matrix(part["x"])
                    width = max(q.shape[1], x.shape[1])
                    for i, best, scores in no_random_access(_wide(q, width), _wide(x, width), ids, part_ids, k):
                        yield pd.DataFrame({"query_id": part_ids[i], "vec_id": best, "score": scores.astype(np.int64)})

    met = asked.unionByName(asking).repartition(max(blocks, rows.sparkSession.sparkContext.defaultParallelism), "block").sortWithinPartitions("block", "asks")
    found = met.mapInPandas(visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
