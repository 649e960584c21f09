"""N-gram Jaccard self-join: prefix filters under several global orders, intersected before verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import components, stored

# Buckets of the frequency tables that all orders share, of shingles and of words: they have this size whatever the input.
BUCKETS, WORD_BUCKETS = 1 << 23, 1 << 18
SLICE = 1 << 14
# Levels by which orders put rare tokens first: the last ones are for shingles that stand out in their table beyond chance.
LEVELS, COMMON = 64, 40
ORDERS = 3
# Rows of a bucket that are compared by places at once to see which have a partner; in longer ones all count as having one.
AT_ONCE = 512
# Before all remaining pairs are listed, each row of a bucket meets only so many rows after it, if in other components.
NEIGHBOURS = (8, 16)
_K = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x632BE59BD9B4E019, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Per byte a number of its own, the same for A-Z and a-z, and whether it is ASCII white space.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _K)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_SPACE] = 0
_BASE = 0x5851F42D4C957F2B
# Powers of the base and of its inverse, as many as the longest text of a task has bytes.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words: lower-cased in A-Z, cut at ASCII white space.

    A word's bytes are the digits of a number modulo 2^64: sums up to each byte give all words of the text at once.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if n > len(_POWERS[0]):
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    space = np.ones(n + 2, bool)
    np.take(_SPACE, raw, out=space[1:-1], mode="clip")
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.take(_BYTE, raw, out=sums[1:], mode="clip")
    sums[1:] *= _POWERS[0][:n]
    np.add.accumulate(sums[1:], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _POWERS[1][start] + (end - start).astype(np.uint64) * _K)


def shingle_set(text: str | None, width: int, words_too: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of a text's `width`-word shingles; of the whole sequence if it is shorter; none without words.

    With `words_too`, also the hashes of each shingle's words, one row per shingle.
    """
    w = word_hashes(text)
    n = len(w)
    if not n:
        none = np.zeros(0, np.uint64)
        return (none, none.reshape(0, 1)) if words_too else none
    span = min(width, n)
    value = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        value = value * _K + w[i : n - span + 1 + i]
    value = _mixed(value)
    if not words_too:
        return _distinct(np.sort(value))
    order = np.argsort(value)  # which of equal shingles comes first is of no account: their words are the same
    value = value[order]
    new = np.append(True, value[1:] != value[:-1])
    return value[new], w[order[new][:, None] + np.arange(span)]


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def add_places(counts: np.ndarray, places: np.ndarray) -> None:
    """Count every place once more, repeated ones as often as they stand there; a one of the counts' own type spares a slow loop."""
    np.add.at(counts, places, counts.dtype.type(1))


def _class(tokens: np.ndarray) -> int:
    """One number for the set; together with its size it names the texts that have exactly this set."""
    return int(np.bitwise_xor.reduce(_mixed(tokens * _K)).view(np.int64)) ^ xxhash.xxh64_intdigest(tokens.tobytes()) >> 1


def levels_of(tokens: np.ndarray, words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How frequent each shingle probably is: by its words' frequencies, above that by its own where it stands out."""
    shingle, word = tables
    by_words = word[(words & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)].sum(axis=1) * np.float32(4 / words.shape[1]) / 2
    own = shingle[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)]
    return np.where(own > 0, COMMON + own, np.minimum(by_words, COMMON).astype(np.int64)).astype(np.uint64)


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, ratio: Fraction) -> np.ndarray:
    """The tokens of which a set similar enough must share one: the first n - ceil(ratio * n) + 1 under global order `order`.

    All orders put rare levels first; within a level each order is a permutation of its own.
    """
    n = len(tokens)
    take = n - -(-n * ratio.numerator // ratio.denominator) + 1
    key = (levels << np.uint64(58)) | (_mixed(tokens ^ _SALTS[order]) >> np.uint64(6))
    some = np.argpartition(key, take - 1)[:take] if take < n else np.arange(n)
    return tokens[some[np.argsort(key[some])]]


def _level_tables(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket of shingles a level above 0 where it exceeds the usual count beyond chance, per bucket of words log2 of its count."""
    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for at, cell, counts in zip(frame["slice"], frame["cell"], frame["counts"], strict=True):
                n = np.frombuffer(counts, np.uint16)
                held = sums.setdefault(at, np.zeros(SLICE, np.int64))
                if cell is None:
                    held += n
                else:
                    held[np.frombuffer(cell, np.uint16)] += n
        for at, values in sums.items():
            yield pd.DataFrame({"slice": [at], "usual": [float(np.median(values))], "counts": [values.tobytes()]})

    sums = stored(counted.repartition("slice").mapInPandas(total, "slice int, usual double, counts binary"))
    shingles, words = F.col("slice") < BUCKETS // SLICE, F.col("slice") >= BUCKETS // SLICE
    usual = float(sums.filter(shingles).agg(F.median("usual")).first()[0] or 0)

    def level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for counts in frame["counts"]:
                over = np.frombuffer(counts, np.int64) - usual
                least = 4 * np.sqrt(usual) + 8
                out.append(np.where(over > least, np.clip(1 + np.floor(2 * np.log2(np.maximum(over, 1) / least)), 1, LEVELS - COMMON - 1), 0).astype(np.uint8).tobytes())
            yield pd.DataFrame({"slice": frame["slice"], "levels": out})

    # one byte per bucket comes to the driver, and log2 of the words' counts
    shingle, word = np.zeros(BUCKETS, np.uint8), np.zeros(WORD_BUCKETS, np.float32)
    for row in sums.filter(shingles).select("slice", "counts").mapInPandas(level, "slice int, levels binary").collect():
        shingle[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["levels"], np.uint8)
    for row in sums.filter(words).collect():
        at = row["slice"] * SLICE - BUCKETS
        word[at : at + SLICE] = np.log2(np.maximum(np.frombuffer(row["counts"], np.int64), 1))
    return shingle, word


def _surveyed(docs: DataFrame, width: int) -> DataFrame:
    """One pass: (doc_id, n, class) per document, and per task the counts of its tokens by slices of the frequency table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS + WORD_BUCKETS, np.uint32)
        for frame in frames:
            sizes, classes = [], []
            for text in frame["text"]:
                tokens, words = shingle_set(text, width, True)
                sizes.append(len(tokens))
                classes.append(_class(tokens) if len(tokens) else None)
                add_places(counts, (tokens & np.uint64(BUCKETS - 1)).astype(np.int64))
                add_places(counts, (words[:, 0] & np.uint64(WORD_BUCKETS - 1)).astype(np.int64) + BUCKETS)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n": np.array(sizes, np.int64), "class": pd.array(classes, "Int64"), "slice": None, "cell": None, "counts": None})
        for i in range(len(counts) // SLICE):
            part = np.minimum(counts[i * SLICE : (i + 1) * SLICE], 65535).astype(np.uint16)
            some = np.flatnonzero(part)
            if len(some):
                # few counts travel with their places, many without
                sparse = len(some) < SLICE // 3
                yield pd.DataFrame({"doc_id": [None], "n": [None], "class": [None], "slice": [i], "cell": [some.astype(np.uint16).tobytes() if sparse else None], "counts": [(part[some] if sparse else part).tobytes()]})

    return docs.select("doc_id", "text").mapInPandas(read, f"doc_id {kind}, n long, class long, slice int, cell binary, counts binary")


def _may_reach(n_a, pos_a, n_b, pos_b, percent: int):
    """Whether sets that share a token at these places, and none before, can still be similar enough."""
    return np.minimum(n_a - pos_a, n_b - pos_b) * (100 + percent) >= percent * (n_a + n_b)


def _bucket_rows(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by token, n and class: repeated ones and those alone in their bucket go; each gets a leader that it may be similar to.

    The leader is the first row of its run within the size ratio, or none (the row itself) if their places in the prefix
    rule it out. Only the last row is carried from one frame to the next.
    """
    columns = ["token", "n", "class", "pos"]
    last: np.ndarray | None = None  # waits for its right neighbour
    shared = False  # whether it has a left neighbour in its bucket
    head = (None, 0, 0, 0)  # token, n, class and place of the run's first row

    def led(rows: np.ndarray) -> np.ndarray:
        nonlocal head
        out = np.empty(len(rows), np.int64)
        for i, (token, n, cls, pos) in enumerate(rows.tolist()):
            if token != head[0] or n * percent > head[1] * 100:
                head = (token, n, cls, pos)
            out[i] = head[2] if _may_reach(n, pos, head[1], head[3], percent) else cls
        return out

    def out(rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).assign(leader=led(rows))

    for frame in frames:
        rows = frame[columns].to_numpy(np.int64)
        if last is not None:
            rows = np.concatenate([last, rows])
        if not len(rows):
            continue
        keep = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        rows = rows[keep]
        next_same = rows[1:, 0] == rows[:-1, 0]
        left, right = np.concatenate([[shared], next_same]), np.concatenate([next_same, [False]])
        some = rows[:-1][(left | right)[:-1]]
        if len(some):
            yield out(some)
        last, shared = rows[-1:], bool(left[-1])
    if last is not None and shared:
        yield out(last)


def _whole_buckets(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[np.ndarray]:
    """Rows of a stream sorted by token, cut so that no bucket is divided."""
    waiting: list[np.ndarray] = []
    for frame in frames:
        rows = frame[columns].to_numpy(np.int64)
        if not len(rows):
            continue
        if waiting and waiting[-1][-1, 0] != rows[0, 0]:
            yield np.concatenate(waiting)
            waiting = []
        before = np.flatnonzero(rows[:, 0] != rows[-1, 0])
        start = int(before[-1]) + 1 if len(before) else 0
        if start:
            yield np.concatenate([*waiting, rows[:start]])
            waiting = []
        waiting.append(rows[start:])
    if waiting:
        yield np.concatenate(waiting)


def _bounds(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]])


def _partnered(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Classes that fit some other row of a bucket in size and place."""
    for rows in _whole_buckets(frames, ["token", "n", "class", "pos"]):
        bounds, found = _bounds(rows), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            _, n, cls, pos = rows[a:b].T
            if b - a <= AT_ONCE:
                fits = _may_reach(n[:, None], pos[:, None], n[None], pos[None], percent)
                np.fill_diagonal(fits, False)
                cls = cls[fits.any(axis=1)]
            found.append(cls)
        yield pd.DataFrame({"class": np.unique(np.concatenate(found))})


def _cross_pairs(frames: Iterator[pd.DataFrame], percent: int, near: int) -> Iterator[pd.DataFrame]:
    """Pairs of classes that share a bucket, fit in size and place and lie in different components; all, or those up to `near` rows apart."""
    for rows in _whole_buckets(frames, ["token", "n", "class", "pos", "component"]):
        for stride in range(1, min(near, len(rows) - 1) + 1):
            x, y = rows[:-stride], rows[stride:]
            fits = (x[:, 0] == y[:, 0]) & (x[:, 4] != y[:, 4]) & (y[:, 1] * percent <= x[:, 1] * 100) & _may_reach(x[:, 1], x[:, 3], y[:, 1], y[:, 3], percent)
            if fits.any():
                yield pd.DataFrame(np.unique(np.sort(np.column_stack([x[fits, 2], y[fits, 2]]), axis=1), axis=0), columns=["a", "b"])
        if near:
            continue
        bounds = _bounds(rows)
        # buckets of one component only are the most: leave them out at once
        differ = np.flatnonzero((rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 4] != rows[:-1, 4]))
        out = []
        for k in np.unique(np.searchsorted(bounds, differ, side="right") - 1).tolist():
            _, n, cls, pos, comp = rows[bounds[k] : bounds[k + 1]].T
            ends = np.searchsorted(n, n * 100 // percent, side="right")
            for i in range(len(n)):
                others = np.arange(i + 1, ends[i])
                others = others[(comp[others] != comp[i]) & _may_reach(n[i], pos[i], n[others], pos[others], percent)]
                if len(others):
                    out.append(np.column_stack([np.minimum(cls[i], cls[others]), np.maximum(cls[i], cls[others])]))
        if out:
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`: groups linked by 100 * intersection >= percent * union.

    A set holds the distinct `width`-word shingles of the whole text, words lower-cased in A-Z and cut at ASCII white space.
    Texts without words (null, empty) have no shingle and stay alone; shorter texts are one shingle. component_id is the
    smallest doc_id reachable by links. Equal sets count as one class, so copies are linked without pairs. Repeated ids are
    rows of their own; a null doc_id gets its group's smallest id or null. An empty table gives an empty result; other
    columns are not read.

    Classes meet in buckets of rare prefix tokens of the first order. A first round compares each bucket's rows with a
    leader only, the next ones rows a few places apart; what these link needs no further comparing. All pairs
    still in different components follow. A pair is
    verified on full sets only if its prefixes under the other orders meet as well. A bucket's rows are numbers of
    24 bytes; frequent tokens stand last in every order and seldom are in a prefix.
    """
    ratio = Fraction(percent, 100)
    surveyed = stored(_surveyed(docs, width))
    texts = surveyed.filter("slice IS NULL").select("doc_id", "n", "class")
    shipped = docs.sparkSession.sparkContext.broadcast(_level_tables(surveyed.filter("slice IS NOT NULL").select("slice", "cell", "counts")))

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, seen = shipped.value, set()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                tokens, words = shingle_set(text, width, True)
                if len(tokens) and (name := _class(tokens)) not in seen:
                    seen.add(name)  # copies in one task leave it once; 8 bytes a text
                    rows.append((prefix(tokens, levels_of(tokens, words, tables), 0, ratio), len(tokens), name))
            if rows:
                lengths = [len(r[0]) for r in rows]
                yield pd.DataFrame({
                    "token": np.concatenate([r[0] for r in rows]).view(np.int64), "n": np.repeat([r[1] for r in rows], lengths),
                    "class": np.repeat(np.array([r[2] for r in rows], np.int64), lengths), "pos": np.concatenate([np.arange(k) for k in lengths])})

    met = docs.select("text").mapInPandas(prefixes, "token long, n int, class long, pos int").repartition("token").sortWithinPartitions("token", "n", "class")
    buckets = stored(met.mapInPandas(lambda frames: _bucket_rows(frames, percent), "token long, n int, class long, pos int, leader long"))

    # whole sets, and prefixes under the other orders, of the classes that share a bucket: from one document each
    by_token = buckets.select("token", "n", "class", "pos").repartition("token").sortWithinPartitions("token", "n", "class")
    wanted = by_token.mapInPandas(lambda frames: _partnered(frames, percent), "class long").distinct()
    one = texts.groupBy("class").agg(F.min("doc_id").alias("_id")).join(wanted, "class", "left_semi")

    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shipped.value
        for frame in frames:
            rows = []
            for text in frame["text"]:
                tokens, words = shingle_set(text, width, True)
                if len(tokens):
                    levels = levels_of(tokens, words, tables)
                    rows.append((_class(tokens), tokens.view(np.int64), *[prefix(tokens, levels, k, ratio).view(np.int64) for k in range(1, ORDERS)]))
            yield pd.DataFrame(rows, columns=["class", "tokens", *[f"p{k}" for k in range(1, ORDERS)]])

    chosen = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    fields = ", ".join(f"p{k} array<long>" for k in range(1, ORDERS))
    whole = stored(chosen.mapInPandas(sets, f"class long, tokens array<long>, {fields}"))
    names = [f"p{k}" for k in range(1, ORDERS)]
    once = whole.dropDuplicates(["class"])

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs
        for side in ("a", "b"):
            left = left.join(once.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("tokens", *names)]), side)
        # the filters of all orders are intersected first; only what passes them is counted
        meets = F.lit(True)
        for c in names:
            meets = meets & F.arrays_overlap(f"{c}_a", f"{c}_b")
        shared = F.when(meets, F.size(F.array_intersect("tokens_a", "tokens_b"))).otherwise(0)
        return left.filter(shared * (100 + percent) >= (F.size("tokens_a") + F.size("tokens_b")) * percent).select("a", "b")

    tried = stored(buckets.filter("class <> leader").select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct())
    links = stored(verified(tried))
    for near in (*NEIGHBOURS, 0):
        placed = (
            buckets.select("token", "n", "class", "pos").join(components(links).withColumnRenamed("node", "class"), "class", "left")
            .withColumn("component", F.coalesce("component", "class")).repartition("token").sortWithinPartitions("token", "n", "class")
        )
        pairs = placed.mapInPandas(lambda frames, near=near: _cross_pairs(frames, percent, near), "a long, b long").distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(verified(pairs)))
        tried = tried.unionByName(pairs)

    label = components(links).withColumnRenamed("node", "class")
    classes = texts.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("_first")).join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = classes.groupBy("component").agg(F.min("_first").alias("_least"))
    names = classes.join(smallest, "component").select(F.col("class"), F.col("_least"), F.xxhash64("class").alias("_h"))
    # the hash as a further key makes both sides meet by a fresh shuffle, which run-time splitting may cut at a heavy class
    return (
        texts.withColumn("_h", F.xxhash64("class")).join(names, ["class", "_h"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without those whose doc_id is not the smallest of its group: one document of each group stays.

    Rows that share a doc_id are taken for one document and stay or go together; rows with a null doc_id stay.
    """
    groups = similar_groups(docs, width, percent)
    stays = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").join(stays, "doc_id", "left_anti").distinct()
    return docs.join(gone, "doc_id", "left_anti")
