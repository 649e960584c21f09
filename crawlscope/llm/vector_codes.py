"""Compression of vectors to one code per part, by k-means whose bounds use the norm of a sum of moves.

A bound taken in round s says how near the closest other entry of a group can be. In round t it shrinks by the greatest net
displacement of the group's entries between s and t, |C_t - C_s|, which the retained codebooks give; the usual sum of the moves
of single rounds is never smaller. Each bound keeps its round s as a stamp; groups it cannot rule out are scanned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import WRITTEN, dropped, stored
from crawlscope.skew import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Entries of one bound.
GROUP = 16
# Rows of one numpy step.
STEP = 4096
# What rounding of square roots and of stored bounds may err by, relative and absolute.
SLACK = 1e-5


def integers(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE) if len(vectors) else np.zeros((0, 0))


def _cuts(width: int) -> list[slice]:
    """Four consecutive parts, equal where the width allows it, else the first ones longer by one."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(width), PARTS)])
    return [slice(int(e - n), int(e)) for e, n in zip(ends, np.diff(np.r_[0, ends]))]


class Distances:
    """Squared distances between whole numbers. Float products are exact below 2^53, 64-bit ones below 2^63."""

    def __init__(self, greatest: float, width: int):
        bound = max(1, -(-width // PARTS)) * 4.0 * (greatest + 1) ** 2
        if bound >= 2.0**62:
            raise ValueError(f"components up to {greatest / SCALE:g} in {width} places: squared distances exceed 64 bits")
        self.kind = np.float64 if bound < 2.0**52 else np.int64

    def table(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        x, e = x.astype(self.kind), entries.astype(self.kind)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]

    def own(self, x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
        gap = x.astype(self.kind) - entries.astype(self.kind)[code]
        return (gap * gap).sum(axis=1)


def displacement(history: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """(round s, group): how far an entry of the group now lies from where it was in round s, at most."""
    now, count = history[-1].astype(np.float64), int(groups[-1]) + 1
    out = np.zeros((len(history), count))
    for s, past in enumerate(history):
        np.maximum.at(out[s], groups, np.sqrt(((now - past) ** 2).sum(axis=1)))
    return out


def assign(
    x: np.ndarray, history: list[np.ndarray], exact: Distances, code: np.ndarray | None = None, bounds: np.ndarray | None = None, stamps: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the newest codebook, squared distances, bounds and stamps for the next round, and the distances computed.

    `bounds` holds per group the distance to its nearest entry but the assigned one, as it was in round `stamps`.
    """
    entries, t = history[-1], len(history) - 1
    groups = np.arange(len(entries)) // GROUP
    rows, computed = np.arange(len(x)), 0
    count = int(groups[-1]) + 1
    if code is None:
        table = exact.table(x, entries)
        code = table.argmin(axis=1)
        best = table[rows, code].copy()
        table = table.astype(np.float64)
        table[rows, code] = np.inf
        bounds = np.stack([np.sqrt(np.maximum(table[:, groups == g].min(axis=1), 0)) for g in range(count)], axis=1)
        return code, best, bounds, np.full((len(x), count), t, np.uint8), table.size
    best = exact.own(x, entries, code)
    computed += len(x)
    moved = displacement(history, groups)
    lower = np.maximum(0, bounds.astype(np.float64) * (1 - SLACK) - moved[stamps, np.arange(count)[None, :]] * (1 + SLACK) - SLACK)
    old, old_best = code, best
    # only a group whose bound lies clearly above the own distance cannot hold a nearer entry, or an equal one of lower index
    open_groups = lower <= np.sqrt(best.astype(np.float64))[:, None] * (1 + SLACK) + SLACK
    near, near_at = best.copy(), code.copy()
    bounds, stamps = bounds.copy(), stamps.copy()
    scanned: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g in range(count):
        at = np.flatnonzero(open_groups[:, g])
        if not len(at):
            continue
        members = np.flatnonzero(groups == g)
        table = exact.table(x[at], entries[members])
        computed += table.size
        least = table.argmin(axis=1)
        value, index = table[np.arange(len(at)), least], members[least]
        better = (value < near[at]) | ((value == near[at]) & (index < near_at[at]))
        near[at[better]], near_at[at[better]] = value[better], index[better]
        scanned.append((g, at, table))
    code, best = near_at, near
    left = np.flatnonzero(code != old)  # the entry given up counts in its group's bound from now on
    g = groups[old[left]]
    bounds[left, g] = np.minimum(lower[left, g], np.sqrt(old_best[left].astype(np.float64)))
    stamps[left, g] = t
    for g, at, table in scanned:
        table = table.astype(np.float64)
        own = groups[code[at]] == g
        table[np.flatnonzero(own), code[at[own]] - g * GROUP] = np.inf
        bounds[at, g], stamps[at, g] = np.sqrt(np.maximum(table.min(axis=1), 0)), t
    return code, best, bounds, stamps, computed


def _round(histories: list[list[np.ndarray]], cuts: list[slice], exact: Distances, first: bool):
    """One round over the rows of a task; a last row carries what its rows add to each entry's sums and counts."""
    count = len(histories[0][-1])
    groups = -(-count // GROUP)
    width = cuts[-1].stop

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros((count, c.stop - c.start + 1), np.int64) for c in cuts]
        computed = 0
        for frame in frames:
            for i in range(0, len(frame), STEP):
                part = frame.iloc[i : i + STEP]
                x = np.frombuffer(b"".join(part["_x"]), np.int64).reshape(len(part), width) if width else np.zeros((len(part), 0), np.int64)
                n = len(part)
                if not first:
                    codes = np.frombuffer(b"".join(part["_codes"]), np.uint8).reshape(n, PARTS)
                    bounds = np.frombuffer(b"".join(part["_bounds"]), np.float32).reshape(n, PARTS, groups)
                    stamps = np.frombuffer(b"".join(part["_stamps"]), np.uint8).reshape(n, PARTS, groups)
                new = []
                for p, c in enumerate(cuts):
                    before = () if first else (codes[:, p].astype(np.int64), bounds[:, p], stamps[:, p])
                    code, best, bound, stamp, looked = assign(x[:, c], histories[p], exact, *before)
                    new.append((code, best, bound, stamp))
                    computed += looked
                    np.add.at(totals[p], code, np.c_[x[:, c], np.ones(n, np.int64)])
                codes_out = np.stack([a[0] for a in new], axis=1).astype(np.uint8)
                bounds_out, stamps_out = np.stack([a[2] for a in new], axis=1).astype(np.float32), np.stack([a[3] for a in new], axis=1)
                yield pd.DataFrame({
                    "_row": part["_row"].to_numpy(), "_x": part["_x"].to_numpy(), "_codes": [r.tobytes() for r in codes_out],
                    "_error": np.sum([a[1].astype(np.int64) for a in new], axis=0), "_bounds": [r.tobytes() for r in bounds_out],
                    "_stamps": [r.tobytes() for r in stamps_out], "_sums": None, "_computed": pd.array([None] * n, "Int64")})
        if computed:
            flat = np.concatenate([t.ravel() for t in totals])
            yield pd.DataFrame({"_row": None, "_x": None, "_codes": None, "_error": pd.array([None], "Int64"), "_bounds": None, "_stamps": None,
                                "_sums": [flat], "_computed": pd.array([computed], "Int64")})

    return run


def compress(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256, and `computed_share`, the share of all distances that were computed.

    Rows whose vector is null or holds null or non-finite components are left out. Rows of null `vec` take part but start no
    entry; repeated rows count as often as they stand, and of equal ids the smaller vector comes first. With fewer than 256 ids the
    codebooks have so many entries; without any row with an id, codes and errors are null. Vectors of another length than the one of the
    smallest id (there can be no common part) keep a null code and error; empty ones get code 0 and error 0. Widths that four
    does not divide give the first parts one component more. Components so large that squared distances leave 64 bits raise ValueError.
    Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    sound = vectors.filter(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = sound.select(F.struct(F.col(vec).alias("v"), F.col(label).alias("l")).alias("_row"), F.col(embedding).cast("array<double>").alias("_e"))
    named = rows.filter(F.col("_row.v").isNotNull())
    smallest = named.orderBy("_row.v", "_e").limit(1).collect()
    out_type = f"struct<v:{vectors.schema[vec].dataType.simpleString()},l:{vectors.schema[label].dataType.simpleString()}>"
    nothing = {"_codes": "binary", "_error": "long"}
    if not smallest:
        return _answer(rows.select("_row", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]), vec, label, "", None)
    width = len(smallest[0]["_e"])
    fits = F.size("_e") == width
    seeds = named.filter(fits).orderBy("_row.v", "_e").limit(ENTRIES).collect()
    books = integers(pd.Series([np.asarray(r["_e"]) for r in seeds]))
    greatest = rows.filter(fits).agg(F.max(F.greatest(F.abs(F.coalesce(F.array_max("_e"), F.lit(0.0))), F.abs(F.coalesce(F.array_min("_e"), F.lit(0.0)))))).first()[0]
    exact, cuts = Distances(np.ceil(float(greatest) * SCALE), width), _cuts(width)
    histories = [[books[:, c].astype(np.int64)] for c in cuts]
    schema = f"_row {out_type}, _x binary, _codes binary, _error long, _bounds binary, _stamps binary, _sums array<long>, _computed long"

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = integers(frame["_e"]).astype(np.int64) if len(frame) else np.zeros((0, 0), np.int64)
            yield pd.DataFrame({"_row": frame["_row"].to_numpy(), "_x": [r.tobytes() for r in x]})

    state = rows.filter(fits).mapInPandas(packed, f"_row {out_type}, _x binary")
    old: str | None = None
    computed = total = 0
    for t in range(ROUNDS + 1):
        state = stored(state.filter(F.col("_row").isNotNull()).mapInPandas(_round(histories, cuts, exact, t == 0), schema))
        if old is not None:
            dropped(spark, [old])  # the new state holds all of it
        old = WRITTEN[-1]
        tally = state.filter(F.col("_sums").isNotNull())
        computed += tally.agg(F.sum("_computed")).first()[0] or 0
        # (width + 4) * 256 sums, whatever the number of rows
        sums = tally.select(F.posexplode("_sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
        flat = np.zeros(len(books) * (width + PARTS), np.int64)
        for r in sums.collect():
            flat[r["at"]] = r["s"]
        begin, number = 0, 0
        for p, c in enumerate(cuts):
            size = len(books) * (c.stop - c.start + 1)
            part = flat[begin : begin + size].reshape(len(books), -1)
            begin += size
            number = int(part[:, -1].sum())
            if t < ROUNDS:
                entries = histories[p][-1].copy()
                used = part[:, -1] > 0
                entries[used] = part[used, :-1] // part[used, -1:]
                histories[p].append(entries)
        total += number * len(books) * PARTS
    digits = ",".join(str(v) for h in histories for entry in h[-1] for v in entry)
    coded = state.filter(F.col("_row").isNotNull()).select("_row", "_codes", "_error")
    others = rows.filter(~fits).select("_row", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()])
    return _answer(coded.unionByName(others), vec, label, sha256(digits.encode()).hexdigest(), computed / total if total else None)


def _answer(coded: DataFrame, vec: str, label: str, digest: str, share: float | None) -> DataFrame:
    """Sums per label joined back; a label may hold any share of the rows."""
    keyed = coded.withColumn("_label", F.to_json(F.struct("_row.l")))  # distinct for each value, and not null for null
    sums = keyed.groupBy("_label").agg(F.sum("_error").alias("_label_error"), F.count(F.lit(1)).alias("_n"))
    return lookup_join(keyed, sums, ["_label"], weight="_n").select(
        F.col("_row.v").alias(vec), F.col("_row.l").alias(label), F.lower(F.hex("_codes")).alias("code"), F.col("_error").alias("error"),
        F.col("_label_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"), F.lit(share).cast("double").alias("computed_share"))
