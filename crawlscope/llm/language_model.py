"""Scoring of texts by online logistic context mixing over the bits of words' classes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import ascii_words, stored

# Words that tasks know by heart, at most; all others are counted and joined like rows. Seen twice at least.
KNOWN = 1 << 20
HELD_OUT, MIXER = 0, 1  # remainders of crc32(doc_id) mod 10: never learned from; weights are learned from
ESCAPE, END = 0, 1  # classes of words that tasks don't know, and of the end of a text
CLASSES, DEPTH = 256, 8
# Rows of the hashed context tables, and of the spelling table; each row holds one count per class or byte.
ROWS, SPELLING = 1024, 8192
SLICE = 1 << 14
FREQUENT = 255
# Words after which a text's weights move, and how far.
STEP, RATE = 64, 0.002
# Trust in a text's own earlier words at its start, and the words that this first guess counts for.
OWN, GUESS = 0.05, 20
PORTION = 1_200_000
INPUTS = 6
_TABLES = {"order0": 1, "class": CLASSES, "word": ROWS, "classes": ROWS, "frequent": FREQUENT + 1, "spelling1": CLASSES, "spelling2": SPELLING, "spelling3": SPELLING}
_FIRST = np.concatenate([[0], np.cumsum(list(_TABLES.values()))])


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _tail(word: bytes) -> int:
    """The last three bytes, last first: words with alike endings have near tails."""
    return int.from_bytes(word[::-1][:3].ljust(3, b"\0"), "big")


def _remainder(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10, F.lit(2))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(hash, tail, c) of the words of all training texts, summed within each portion of a task first."""
    def tell(counts: dict[bytes, int]) -> pd.DataFrame:
        words = list(counts)
        return pd.DataFrame({"hash": np.fromiter(map(_hash, words), np.int64, len(words)), "tail": np.fromiter(map(_tail, words), np.int32, len(words)), "c": np.fromiter(counts.values(), np.int64, len(words))})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = defaultdict(int)
        for frame in frames:
            for text in frame["text"]:
                for w in ascii_words(text):
                    counts[w] += 1
                if len(counts) > 300_000:
                    yield tell(counts)
                    counts = defaultdict(int)
        if counts:
            yield tell(counts)

    return docs.select("text").mapInPandas(read, "hash long, tail int, c long").groupBy("hash").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


def lexicon_of(words: pd.DataFrame) -> dict[str, np.ndarray]:
    """The known words: sorted hashes with counts, classes and log-probabilities within the class.

    Classes are equal shares of the running text in the order of word endings, so their bits tell endings apart.
    """
    words = words.sort_values("hash", kind="stable")
    hashes, c, tail = (words[k].to_numpy(np.int64) for k in ("hash", "c", "tail"))
    order = np.lexsort((hashes, tail))
    mass = np.cumsum(c[order])
    share = (mass - c[order] / 2) / mass[-1] if len(mass) else np.zeros(0)
    cls = np.empty(len(order), np.uint8)
    cls[order] = 2 + np.minimum((share * (CLASSES - 2)).astype(np.int64), CLASSES - 3)
    total = np.bincount(cls, weights=c, minlength=CLASSES)
    frequent = np.zeros(len(order), np.uint8)
    frequent[np.lexsort((hashes, -c))[:FREQUENT]] = 1 + np.arange(min(FREQUENT, len(order)))
    return {"hash": hashes, "c": c, "cls": cls, "within": np.log2(c / total[cls]), "frequent": frequent}


def find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes, -1 where unknown."""
    if not len(sorted_hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


class Portion:
    """Texts of a portion as one stream of words, each text followed by its end."""

    def __init__(self, texts: list[str | None], lexicon: dict[str, np.ndarray]):
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = []
        for text in texts:
            words = ascii_words(text)
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        self.words = list(number)
        self.hash = np.fromiter(map(_hash, self.words), np.int64, len(self.words))
        self.place = find(lexicon["hash"], self.hash)
        safe = np.maximum(self.place, 0)
        pick = lambda values, other: np.append(np.where(self.place >= 0, values[safe] if len(values) else 0, other), other)
        end = len(self.words)
        self.sizes = np.array([len(i) + 1 for i in ids], np.int64)
        self.token = np.concatenate([np.append(i, end) for i in ids]) if ids else np.zeros(0, np.int64)
        cls = pick(lexicon["cls"], ESCAPE)
        cls[end] = END
        mark = np.append(self.hash & (ROWS - 1), 0)
        frequent = pick(lexicon["frequent"], 0)
        within = pick(lexicon["within"], 0.0)
        self.cls, self.within = cls[self.token].astype(np.int64), within[self.token]
        first = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(ids)), self.sizes)
        self.at = np.arange(len(self.token)) - first[self.of]
        before = lambda values, k: np.where(self.at >= k, np.roll(values, k), END)
        c1, c2 = before(self.cls, 1), before(self.cls, 2)
        freq = frequent[self.token].astype(np.int64)
        # the last frequent word before this one, within the text
        place = np.arange(len(freq))
        seen = np.maximum.accumulate(np.where(freq > 0, place, -1)) if len(freq) else place
        seen = np.concatenate([[-1], seen[:-1]]) if len(freq) else seen
        last = np.where(seen >= first[self.of], freq[np.maximum(seen, 0)], 0) if len(freq) else place
        self.rows = [np.zeros(len(c1), np.int64), _FIRST[1] + c1, _FIRST[2] + before(mark[self.token], 1) % ROWS,
                     _FIRST[3] + ((c1 * 257 + c2) * 40503 >> 3) % ROWS, _FIRST[4] + last]

        # how often a word stands among the words of its text before
        kin = np.lexsort((place, self.token, self.of)) if len(place) else place
        same = np.concatenate([[False], (self.token[kin][1:] == self.token[kin][:-1]) & (self.of[kin][1:] == self.of[kin][:-1])]) if len(kin) else kin
        heads = np.maximum.accumulate(np.where(same, 0, place)) if len(kin) else kin
        earlier = np.empty(len(place), np.int64)
        earlier[kin] = place - heads
        self.cache = earlier / np.maximum(self.at, 1)
        self.unknown = np.append(self.place < 0, False)[self.token]

    def spellings(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For the bytes of all unknown words and their ends: the cells of the three spelling tables, and the word."""
        which = np.flatnonzero(self.place < 0)
        chosen = [self.words[i] for i in which]
        text = np.frombuffer(b"".join(b"\0\0\0" + w + b"\0" for w in chosen), np.uint8).astype(np.int64)
        lengths = np.fromiter((len(w) + 4 for w in chosen), np.int64, len(chosen))
        owner = np.repeat(which, lengths)
        at = np.flatnonzero(np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= 3)
        one, two, three = text[at - 1], text[at - 2], text[at - 3]
        rows = [one, (one * 257 + two) * 40503 % 65521 % SPELLING, ((one * 257 + two) * 257 + three) * 40503 % 16777213 % SPELLING]
        return [(_FIRST[5 + k] + r) * CLASSES + text[at] for k, r in enumerate(rows)], owner[at]


def portions(frame: pd.DataFrame) -> Iterator[slice]:
    sizes = frame["text"].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    start = held = 0
    for i, s in enumerate(sizes):
        if held and held + s > PORTION:
            yield slice(start, i)
            start, held = i, 0
        held += s + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


def _texts(frame: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame["text"]]


def _context_counts(docs: DataFrame, lexicon) -> np.ndarray:
    """Counts of classes per context row, and of bytes per spelling row, over all given texts: tables of fixed size, summed by slices."""
    cells, contexts = int(_FIRST[-1]) * CLASSES, int(_FIRST[5]) * CLASSES

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(cells, np.int64)
        for frame in frames:
            for part in portions(frame):
                p = Portion(_texts(frame.iloc[part]), lexicon.value)
                for row in p.rows:
                    table[:contexts] += np.bincount(row * CLASSES + p.cls, minlength=contexts)
                for cell in p.spellings()[0]:
                    np.add.at(table, cell, 1)
        for i in range(0, cells, SLICE):
            some = np.flatnonzero(table[i : i + SLICE])
            if len(some):
                yield pd.DataFrame({"slice": [i], "cell": [some.astype(np.int32)], "n": [table[i : i + SLICE][some]]})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for at, cell, n in zip(frame["slice"], frame["cell"], frame["n"], strict=True):
                sums.setdefault(at, np.zeros(SLICE, np.int64))[cell] += n
        for at, values in sums.items():
            yield pd.DataFrame({"slice": [at], "n": [values]})

    parts = docs.select("text").mapInPandas(read, "slice int, cell array<int>, n array<long>")
    sums = parts.repartition("slice").mapInPandas(total, "slice int, n array<long>").collect()
    table = np.zeros(-(-cells // SLICE) * SLICE, np.int64)
    for row in sums:
        table[row["slice"] : row["slice"] + SLICE] = row["n"]
    return table[:cells].reshape(-1, CLASSES)


def bit_predictors(table: np.ndarray) -> np.ndarray:
    """For every context row and node of the class tree: log-odds of a 1, shrunken towards the row of no context."""
    rows = table[: _FIRST[5]].astype(np.float64)
    nodes = np.zeros((len(rows), CLASSES, 2))
    level = rows
    for depth in range(DEPTH - 1, -1, -1):
        pair = level.reshape(len(rows), 1 << depth, 2)
        nodes[:, 1 << depth : 2 << depth] = pair
        level = pair.sum(axis=2)
    base = (nodes[0, :, 1] + 0.4) / (nodes[0].sum(axis=1) + 0.8)
    p = (nodes[:, :, 1] + 4 * base) / (nodes.sum(axis=2) + 4)
    p[0] = base
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)).astype(np.float32)


def spelling_tables(table: np.ndarray) -> list[np.ndarray]:
    """Counts of bytes behind one, two and three bytes, with each row's sum; flat like their cells."""
    return [np.column_stack([t.ravel(), np.repeat(t.sum(axis=1), CLASSES)]).astype(np.float32) for t in (table[_FIRST[5 + k] : _FIRST[6 + k]] for k in range(3))]


def spelled_bits(p: Portion, tables: list[np.ndarray]) -> np.ndarray:
    """log2 of the probability of each word's bytes if it is unknown, else 0: longer contexts shrink towards shorter ones."""
    cells, owner = p.spellings()
    q = np.full(len(owner), 1.0 / CLASSES)
    for k, cell in enumerate(cells):
        n = tables[k][cell - int(_FIRST[5 + k]) * CLASSES]
        q = (n[:, 0] + 3 * q) / (n[:, 1] + 3)
    return np.bincount(owner, weights=np.log2(q), minlength=len(p.words) + 1)


def start_weights() -> np.ndarray:
    """One weight set per gate, the depth of the bit: first all trust in the mean of the inputs, no offset."""
    w = np.full((DEPTH, INPUTS), 1.0 / (INPUTS - 1), np.float32)
    w[:, -1] = 0
    return w


def mixed_bits(p: Portion, predictors: np.ndarray, weights: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the probability of each text, and each text's weights at its end.

    Texts move in step: for STEP words of each, the predictors of every bit are mixed by the weights of its gate, and the
    word so coded is refined by how often the text has used it before; then weights and that trust follow the errors. Each
    text starts from `weights` and adapts by itself. `within` is log2 of each word's probability in its class; for unknown
    words met first in a text it is left to the caller.
    """
    n = len(p.sizes)
    own = np.repeat(weights[None], n, axis=0)
    bits = np.zeros(n)
    trusted, seen = np.full(n, OWN * GUESS), np.full(n, float(GUESS))
    flat = predictors.ravel()
    order = np.argsort(p.at // STEP, kind="stable")
    turns = np.searchsorted((p.at // STEP)[order], np.arange(int(p.at.max()) // STEP + 2)) if len(p.at) else [0]
    for a, b in zip(turns[:-1], turns[1:], strict=True):
        some = order[a:b]
        cls, of = p.cls[some], p.of[some]
        rows = [r[some] * CLASSES for r in p.rows]
        inside = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        who = of[inside]
        times = np.diff(np.append(inside, len(some)))
        total = np.zeros(len(some), np.float32)
        for depth in range(DEPTH):
            node = (cls | CLASSES) >> (DEPTH - depth)
            bit = ((cls >> (DEPTH - 1 - depth)) & 1).astype(np.float32)
            x = np.empty((INPUTS, len(some)), np.float32)
            for k, r in enumerate(rows):
                np.take(flat, r + node, out=x[k], mode="clip")
            x[-1] = 0.3
            w = own[who, depth].T.repeat(times, axis=1)
            z = (w * x).sum(axis=0)
            np.clip(z, -14, 14, out=z)
            q = 1 / (1 + np.exp(-z))
            total += np.log2(np.where(bit > 0, q, 1 - q))
            moved = np.add.reduceat((bit - q) * x, inside, axis=1)
            own[who, depth] += RATE * moved.T
        trust = (trusted[who] / seen[who]).repeat(times)
        cache = trust * p.cache[some]
        alone = p.unknown[some] & (cache == 0)
        # 2 ** -1000 keeps an endless word from becoming impossible
        word = (1 - trust) * np.exp2(np.maximum(total + np.where(alone, 0, within[some]), -1000))
        bits += np.bincount(of, weights=np.log2(cache + word), minlength=n)
        trusted[who] += np.add.reduceat(np.where(alone, 0, cache / (cache + word)), inside)
        seen[who] += times
    return bits, own


def _learned_weights(docs: DataFrame, model) -> np.ndarray:
    """The mean of the weights at the ends of all given texts, by words: where texts of the corpus start best."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words, w = np.zeros((DEPTH, INPUTS)), 0, start_weights()
        for frame in frames:
            for part in portions(frame):
                p = Portion(_texts(frame.iloc[part]), model.value["lexicon"])
                _, own = mixed_bits(p, model.value["predictors"], w, p.within)
                total += (own * p.sizes[:, None, None]).sum(axis=0)
                words += int(p.sizes.sum())
                w = (total / words).astype(np.float32)  # the next portion goes on from here
        if words:
            yield pd.DataFrame({"words": [words], "total": [total.ravel()]})

    rows = docs.select("text").mapInPandas(read, "words long, total array<double>")
    sums = rows.select("words", F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("t"), F.sum("words").alias("n")).collect()
    if not sums:
        return start_weights()
    w = np.zeros(DEPTH * INPUTS)
    for r in sums:
        w[r["pos"]] = r["t"] / r["n"]
    return w.reshape(DEPTH, INPUTS).astype(np.float32)


def score_texts(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Null and empty texts are their end alone. A null doc_id is learned from and not held out; repeated rows count as often as
    they stand there and score alike. An empty table gives an empty result; other columns are not read. With no training
    text at all, N and V are 0 and every word is unknown.

    Word counts come from all training rows, contexts and spellings from those not of remainder MIXER, weights from that remainder
    alone; context tables have a fixed size. The model codes each word as the eight bits of its class,
    predicted by five contexts whose log-odds are mixed by weights of the bit's depth that follow the text, then the word
    within its class, refined by the text's own earlier words. Words seen less than twice, or too rare to be known by every
    task, share one class: there the next word is one of the rare ones seen, by count, or spelled byte by byte.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", _remainder(F.col("doc_id")).alias("_r"))
    training = named.filter(F.col("_r") != HELD_OUT)
    counts = stored(_word_counts(training))
    ends = training.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    # the least count of which no more than `known` words have it or more
    steps = counts.filter("c >= 2").groupBy("c").count().withColumn("c", F.least("c", F.lit(100_000))).groupBy("c").agg(F.sum("count").alias("k")).orderBy(F.desc("c")).collect()
    least, room = 2, known
    for r in steps:
        room -= r["k"]
        if room < 0:
            least = r["c"] + 1
            break
    lexicon = lexicon_of(counts.filter(F.col("c") >= least).select("hash", "tail", "c").toPandas())  # `known` rows at most
    shared = spark.sparkContext.broadcast(lexicon)
    table = _context_counts(training.filter(F.col("_r") != MIXER), shared)
    model = {"lexicon": lexicon, "predictors": bit_predictors(table), "spelling": spelling_tables(table)}
    first = spark.sparkContext.broadcast(model)
    weights = _learned_weights(training.filter(F.col("_r") == MIXER), first)
    floor = np.log10(n_all + 0.1 * (v_all + 1))
    # of the words that tasks don't know, which share has been seen: what the counts one higher tell of a new word
    few = counts.filter(F.col("c") <= least).groupBy("c").count().collect()
    of_count = {r["c"]: r["count"] for r in few}
    rare_words = sum(c * k for c, k in of_count.items() if c < least)
    again, new = sum((c + 1) * of_count.get(c + 1, 0) for c in range(1, least)), of_count.get(1, 0)
    share = again / (again + new) if again and rare_words else 0.0
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, predictors, spelling = (first.value[k] for k in ("lexicon", "predictors", "spelling"))
        row_id = TaskContext.get().partitionId() << 40
        for frame in frames:
            for part in portions(frame):
                some = frame.iloc[part]
                p = Portion(_texts(some), lexicon)
                n = len(p.sizes)
                spelled = spelled_bits(p, spelling)
                bits, _ = mixed_bits(p, predictors, weights, p.within + spelled[p.token])
                c = np.append(np.where(p.place >= 0, lexicon["c"][np.maximum(p.place, 0)] if len(lexicon["c"]) else 0, 0), ends)
                told = np.append(p.place >= 0, True)[p.token]
                base = np.where(told, np.log10(c[p.token] + 0.1) - floor, 0.0)
                keys = row_id + np.arange(n)
                row_id += n
                size = some["text"].map(lambda t: len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0).to_numpy()
                yield pd.DataFrame({
                    "key": keys, "doc_id": some["doc_id"].to_numpy(), "held_out": some["_r"].to_numpy() == HELD_OUT, "n_tokens": p.sizes,
                    "n_known": np.bincount(p.of, weights=told & (c[p.token] > 0), minlength=n).astype(np.int64), "base_score": np.bincount(p.of, weights=base, minlength=n),
                    "score": bits * np.log10(2), "bytes": size, "hash": None, "tf": None, "spelled": None})
                rare = np.flatnonzero(~told)
                if len(rare):
                    pair, times = np.unique(np.column_stack([p.of[rare], p.token[rare]]), axis=0, return_counts=True)
                    yield pd.DataFrame({"key": keys[pair[:, 0]], "hash": p.hash[pair[:, 1]], "tf": times, "spelled": spelled[pair[:, 1]] * np.log10(2)}).reindex(
                        columns=["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bytes", "hash", "tf", "spelled"])

    rows = stored(named.mapInPandas(read, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bytes long, hash long, tf long, spelled double"))
    rare = rows.filter("hash IS NOT NULL").select("key", "hash", "tf", "spelled").join(counts.filter(F.col("c") < least).select("hash", "c"), "hash", "left")
    value = F.coalesce("c", F.lit(0))
    # a word unknown to tasks, the first time in a text: one of the rare words seen, or spelled
    seen, spelt = F.log10(value * (share / max(rare_words, 1))), F.col("spelled") + float(np.log10(1 - share))
    most = F.greatest(seen, spelt)
    first_time = most + F.log10(F.pow(10.0, F.coalesce(seen - most, F.lit(-300.0))) + F.pow(10.0, spelt - most))
    rest = rare.groupBy("key").agg(
        F.sum(F.col("tf") * (F.log10(value + F.lit(0.1)) - F.lit(float(floor)))).alias("_base"), F.sum(F.when(value > 0, F.col("tf")).otherwise(0)).alias("_known"), F.sum(first_time).alias("_score"))
    whole = rows.filter("hash IS NULL").drop("hash", "tf", "spelled").join(rest, "key", "left").withColumn("score", F.col("score") + F.coalesce("_score", F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"))
