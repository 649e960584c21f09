"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest, extended to whole repeated passages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import ascii_words, stored

# Words of a repeated passage that is removed, at least.
LEAST_WORDS = 50
# A word ends a chunk where the gear hash of the last 16 bytes falls in 1 of 4 values, unless another such word is among the
# SPACING words before it. Both depend on nearby text only, so chunkers meet right after an insertion.
MASK_BITS, SPACING = 2, 2
LONGEST = 48
# Consecutive repeated words of one source that make a run worth extending.
SEED = 8
CONTEXT = LONGEST + 16
# Words of the pieces by which windows of the least length are looked for; each window's least piece is its anchor.
ANCHOR = 16
# Chunk digests that a task remembers before it starts afresh.
REMEMBERED = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# one random value per byte, by a rule; zero for the byte that separates texts
_GEAR = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.uint16)
_GEAR = (_GEAR * np.uint16(40503)) ^ (_GEAR >> np.uint16(7))
_GEAR[0] = 0

ROWS = "kind byte, digest long, doc_id long, version long, start int, words int"
RUN = "doc_id long, version long, start int, words int, src_id long, src_version long, src_start int"


def gear(data: bytes) -> np.ndarray:
    """h[i] = 2 * h[i-1] + GEAR[byte i] in 16 bits: the hash of the last 16 bytes at every byte, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8):
        h[w:] = h[w:] + (h[:-w] << np.uint16(w))
    return h


def chunk_ends(words: list[bytes], lengths: np.ndarray, joined: bytes) -> np.ndarray:
    """Numbers of words after which a chunk ends; the last is the number of words."""
    last = np.cumsum(lengths + 1) - 2
    marked = np.flatnonzero(gear(joined)[last] >> np.uint16(16 - MASK_BITS) == 0)
    apart = np.diff(marked, prepend=-SPACING - 1) > SPACING
    ends = np.append(marked[apart] + 1, len(words))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:  # cut evenly from the last marked word on
        starts = ends - gaps
        more = [np.arange(s + LONGEST, e, LONGEST) for s, e in zip(starts[gaps > LONGEST], ends[gaps > LONGEST], strict=True)]
        ends = np.concatenate([ends, *more])
    return np.unique(ends[ends > 0])


def _version(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind 0: a chunk whose digest this task has not met in a document of this or a smaller id; kind 1: any other; kind 2: tells that a digest has others."""
    seen: dict[int, int] = {}
    marked: set[int] = set()
    for frame in frames:
        rows: list[np.ndarray] = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            words = ascii_words(text)
            if not words or pd.isna(doc_id):
                continue
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = chunk_ends(words, lengths, joined)
            starts = np.concatenate([[0], ends[:-1]])
            at = np.concatenate([[0], np.cumsum(lengths + 1)])
            digests = [xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)]
            kinds, marks = [], []
            for d in digests:
                least = seen.get(d)
                if least is None or least > doc_id:
                    seen[d] = doc_id
                    kinds.append(0)
                else:
                    kinds.append(1)
                    if d not in marked:
                        marked.add(d)
                        marks.append(d)
            if len(seen) > REMEMBERED:
                seen.clear()
                marked.clear()
            version = _version(text)
            block = np.empty((len(digests) + len(marks), 6), np.int64)
            block[:, 0] = [*kinds, *[2] * len(marks)]
            block[:, 1] = np.array([*digests, *marks], np.uint64).view(np.int64)
            block[:, 2], block[:, 3] = int(doc_id), version
            block[: len(digests), 4], block[: len(digests), 5] = starts, ends - starts
            block[len(digests) :, 4:] = 0
            rows.append(block)
        if rows:
            all_rows = np.concatenate(rows)
            kind, digest, doc, version, start, words_ = all_rows.T
            yield pd.DataFrame({"kind": kind.astype(np.int8), "digest": digest, "doc_id": doc, "version": version, "start": start, "words": words_})


def _sources(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by digest, doc_id, start. Adds the digest's first place (of kind 0) to every other one of another text.

    Kind 1 passes as it is; kind 2 becomes the source of its digest. Only the current digest's head is carried along.
    """
    head = np.zeros((1, 4), np.int64)  # digest, doc_id, version, start
    known = False
    for frame in frames:
        later = frame[frame["kind"] == 1]
        if len(later):
            yield later.assign(src_id=0, src_version=0, src_start=0)
        rest = frame[frame["kind"] != 1]
        if not len(rest):
            continue
        place = rest[["digest", "doc_id", "version", "start"]].to_numpy(np.int64)
        kind = rest["kind"].to_numpy()
        chunk = kind == 0
        fresh = np.ones(len(place), bool)
        if known:
            place_all = np.concatenate([head, place])
        else:
            place_all = np.concatenate([place[:1] * 0 - 1, place])
        fresh = place_all[1:, 0] != place_all[:-1, 0]
        if not known:
            fresh[0] = True
        # a digest's kind 0 rows come before its kind 2 rows, so its first row here is a chunk
        owner = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), -1))
        source = np.where((owner >= 0)[:, None], place[np.maximum(owner, 0)], head)
        wanted = (chunk & (source[:, 1] != place[:, 1]) & ~fresh) | (kind == 2)
        if wanted.any():
            yield rest[wanted].assign(src_id=source[wanted, 1], src_version=source[wanted, 2], src_start=source[wanted, 3])
        head, known = source[-1:], True


def _runs(frames: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by doc_id, version, start: joins neighbours whose sources are neighbours alike; keeps runs of `seed` words."""
    names = [c.split()[0] for c in RUN.split(", ")]
    held: np.ndarray | None = None
    for frame in frames:
        rows = frame[names].to_numpy(np.int64)
        if held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        a, b = rows[:-1], rows[1:]
        joined = (a[:, [0, 1, 4, 5]] == b[:, [0, 1, 4, 5]]).all(axis=1) & (a[:, 2] + a[:, 3] == b[:, 2]) & (a[:, 6] + a[:, 3] == b[:, 6])
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        total = np.add.reduceat(rows[:, 3], first)
        runs = rows[first]
        runs[:, 3] = total
        held = runs[-1:]
        done = runs[:-1]
        done = done[done[:, 3] >= seed]
        if len(done):
            yield pd.DataFrame(done, columns=names)
    if held is not None and held[0, 3] >= seed:
        yield pd.DataFrame(held, columns=names)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _piece_hashes(words: list[bytes], known: dict[bytes, int], size: int) -> np.ndarray:
    """64-bit hashes of all pieces of `size` words, put together from pieces of powers of two."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    n, power, at = len(words) - size + 1, np.array(ids, np.uint64), 0
    out, width = np.zeros(n, np.uint64), 1
    while width <= size:
        if size & width:
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + power[at : at + n])
            at += width
        power, width = _mixed(power[:-width] * np.uint64(0x94D049BB133111EB) + power[width:]) if len(power) > width else power[:0], width * 2
    return out


def _anchors(words: list[bytes], known: dict[bytes, int], least: int) -> np.ndarray:
    """The least hash of the pieces in every window of `least` words: equal windows have equal anchors."""
    h = _piece_hashes(words, known, min(ANCHOR, least))
    span = least - min(ANCHOR, least) + 1
    width = 1
    while width * 2 <= span:
        h, width = np.minimum(h[:-width], h[width:]) if len(h) > width else h[:0], width * 2
    rest = span - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if len(h) > rest else h[:0]


def _anchor_rows(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Kind 0: an anchor in the first two documents that hold it in this task; kind 1: in any further one, so it is known to repeat."""
    seen: dict[int, tuple[int, bool]] = {}
    known: dict[bytes, int] = {}
    for frame in frames:
        kinds, anchors, docs = [], [], []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            if pd.isna(doc_id):
                continue
            doc_id = int(doc_id)
            for a in np.unique(_anchors(ascii_words(text), known, least)).view(np.int64).tolist():
                first = seen.get(a)
                if first is not None and first[0] == doc_id:
                    continue
                seen[a] = (first[0] if first else doc_id, first is not None)
                kinds.append(1 if first is not None and first[1] else 0)
                anchors.append(a), docs.append(doc_id)
        if len(seen) > REMEMBERED:
            seen.clear()
        if kinds:
            yield pd.DataFrame({"kind": np.array(kinds, np.int8), "anchor": anchors, "doc_id": docs})


def _met_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor, doc_id: those whose anchor stands in another document too, and all of kind 1."""
    last: pd.DataFrame | None = None  # rows of the last anchor that have met no other document
    met: int | None = None
    for frame in frames:
        later = frame[frame["kind"] == 1]
        if len(later):
            yield later[["anchor", "doc_id"]]
        rest = frame[frame["kind"] == 0]
        if last is not None:
            rest = pd.concat([last, rest], ignore_index=True)
        if not len(rest):
            continue
        a, d = rest["anchor"].to_numpy(), rest["doc_id"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(a))))
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        if met is not None and a[0] == met:
            several[0] = True
        hit = several[group]
        if hit.any():
            yield rest.loc[hit, ["anchor", "doc_id"]]
        met = int(a[-1]) if several[-1] else None
        last = None if several[-1] else rest.iloc[[len(rest) - 1]]


def _window_rows(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Windows of `least` words whose anchor another document holds, but for those in passages already found."""
    known: dict[bytes, int] = {}
    for frame in frames:
        out = []
        for doc_id, text, anchors, spans in zip(frame["doc_id"], frame["text"], frame["anchors"], frame["spans"], strict=True):
            words = ascii_words(text)
            of = _anchors(words, known, least).view(np.int64)
            wanted = np.isin(of, np.asarray(anchors, np.int64))
            for s in spans if spans is not None else ():
                wanted[max(0, s["start"]) : max(0, s["start"] + s["words"] - least + 1)] = False
            at = np.flatnonzero(wanted)
            if len(at):
                out.append(pd.DataFrame({"hash": _piece_hashes(words, known, least).view(np.int64)[at], "doc_id": int(doc_id), "version": _version(text), "start": at.astype(np.int32)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _joined_windows(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by doc_id, version, start: windows one word apart become one span."""
    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame[["doc_id", "version", "start", "words", "src_id"]]
        rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(rows):
            continue
        v = rows.to_numpy(np.int64)
        ends = v[:, 2] + v[:, 3]
        first = np.flatnonzero(np.concatenate([[True], (v[1:, :2] != v[:-1, :2]).any(axis=1) | (v[1:, 2] > ends[:-1] - least + 1)]))
        runs = v[first]
        runs[:, 3] = np.maximum.reduceat(ends, first) - runs[:, 2]
        runs[:, 4] = np.minimum.reduceat(v[:, 4], first)
        done = pd.DataFrame(runs, columns=rows.columns)
        held = done.iloc[-1:]
        if len(done) > 1:
            yield done.iloc[:-1]
    if held is not None:
        yield held


def broken_spans(named: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, start, words, src_id): all windows of `least` words that a smaller doc_id holds too and `found` leaves, joined.

    Runs of chunks break where single chunks stand in still smaller documents. Here equal windows meet by their anchors, the
    least hashes of their pieces, and then as wholes, so none is missed. The smallest document of a window never has it in `found`.
    """
    part = F.when(F.col("kind") == 1, F.xxhash64("doc_id")).otherwise(F.col("anchor"))
    rows = named.mapInPandas(lambda frames: _anchor_rows(frames, least), "kind byte, anchor long, doc_id long")
    met = rows.repartition(part).sortWithinPartitions("kind", "anchor", "doc_id").mapInPandas(_met_anchors, "anchor long, doc_id long")
    asked = met.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    there = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    reading = named.withColumn("version", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).join(asked, "doc_id").join(there, ["doc_id", "version"], "left")
    windows = stored(reading.mapInPandas(lambda frames: _window_rows(frames, least), "hash long, doc_id long, version long, start int"))
    source = windows.groupBy("hash").agg(F.min("doc_id").alias("src_id"), F.max("doc_id").alias("_last")).filter("src_id <> _last").drop("_last").withColumn("_h", F.xxhash64("hash"))
    later = windows.withColumn("_h", F.xxhash64("hash")).join(source, ["hash", "_h"]).filter("src_id <> doc_id").select("doc_id", "version", "start", F.lit(least).alias("words"), "src_id")
    ordered = later.repartition("doc_id").sortWithinPartitions("doc_id", "version", "start")
    return ordered.mapInPandas(lambda frames: _joined_windows(frames, least), "doc_id long, version long, start int, words int, src_id long")


def repeated_spans(docs: DataFrame, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, version, start, words, src_id): passages of at least `least` words that also stand in the source document.

    Words are compared in lower case and without their white space. A chunk's source is its place in the
    smallest doc_id, so whatever is removed is kept by a document before. What runs of such chunks miss, because single chunks
    also stand elsewhere, is found by whole windows of `least` words. Passages that repeat within one document only are not reported.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # later chunks of a task don't meet here, so they are dealt out by place: a frequent chunk fills no task
    part = F.when(F.col("kind") == 1, F.xxhash64("doc_id", "start")).otherwise(F.col("digest"))
    met = named.mapInPandas(_chunks, ROWS).repartition(part).sortWithinPartitions("digest", "kind", "doc_id", "start")
    placed = stored(met.mapInPandas(_sources, f"{ROWS}, src_id long, src_version long, src_start int"))
    names = [c.split()[0] for c in RUN.split(", ")]
    source = placed.filter("kind = 2").select("digest", "src_id", "src_version", "src_start").dropDuplicates(["digest"])
    # joined by a key of its own, so that run-time splitting may cut a frequent chunk
    later = placed.filter("kind = 1").drop("src_id", "src_version", "src_start").withColumn("_h", F.xxhash64("digest"))
    later = later.join(source.withColumn("_h", F.xxhash64("digest")), ["digest", "_h"]).filter("src_id <> doc_id")
    repeated = placed.filter("kind = 0").select(*names).unionByName(later.select(*names))
    # rows of one doc_id with one text say the same
    sorted_rows = repeated.repartition("doc_id").sortWithinPartitions("doc_id", "version", "start")
    runs = stored(sorted_rows.mapInPandas(lambda frames: _runs(_distinct(frames), seed), RUN))

    # the words around both ends, here and in the source, tell how far the passage goes on
    def ends(doc: str, version: str, start: str) -> list:
        before, after = F.col(start).cast("int"), (F.col(start) + F.col("words")).cast("int")
        return [F.struct(F.col(doc).alias("doc_id"), F.col(version).alias("version"), at.alias("at"), F.lit(side).alias("side")) for side, at in enumerate((before, after))]

    asked = runs.select(F.explode(F.array(*ends("doc_id", "version", "start"), *ends("src_id", "src_version", "src_start"))).alias("r")).select("r.*").distinct()
    places = asked.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "side")).alias("places"))
    reading = named.withColumn("version", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).join(places, ["doc_id", "version"])
    around = stored(reading.mapInPandas(_contexts, "doc_id long, version long, at int, side int, words binary")).dropDuplicates(["doc_id", "version", "at", "side"])
    spans = runs
    for side, at in ((0, F.lit(0)), (1, F.col("words"))):
        for prefix, own in (("src_", False), ("", True)):
            key = ["doc_id", "version", "start"] if own else ["src_id", "src_version", "src_start"]
            context = around.filter(F.col("side") == side).select(
                F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("at").alias("_a"), F.col("words").alias(f"{prefix}w{side}"))
            spans = spans.join(context, (F.col(key[0]) == F.col("_d")) & (F.col(key[1]) == F.col("_v")) & ((F.col(key[2]) + at).cast("int") == F.col("_a")), "left").drop("_d", "_v", "_a")

    def extended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                before, after = _shared(r.w0, r.src_w0), _shared(r.w1, r.src_w1)
                if r.words + before + after >= least:
                    rows.append((r.doc_id, r.version, r.start - before, r.words + before + after, r.src_id))
            yield pd.DataFrame(rows, columns=["doc_id", "version", "start", "words", "src_id"])

    long_runs = stored(spans.mapInPandas(extended, "doc_id long, version long, start int, words int, src_id long"))
    return long_runs.unionByName(broken_spans(named, long_runs, least))


def _distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for frame in frames:
        key = frame[["doc_id", "version", "start"]].to_numpy(np.int64)
        before = np.concatenate([[last if last is not None else key[0] - 1] if len(key) else np.zeros((0, 3), np.int64), key[:-1]])
        if len(key):
            last = key[-1]
            yield frame[(key != before).any(axis=1)]


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """4 bytes per word around each place, nearest first; side 0 looks back, side 1 ahead."""
    for frame in frames:
        rows = []
        for doc_id, version, text, places in zip(frame["doc_id"], frame["version"], frame["text"], frame["places"], strict=True):
            words = ascii_words(text)
            for place in places:
                at, side = place["at"], place["side"]
                near = words[max(0, at - CONTEXT) : at][::-1] if side == 0 else words[at : at + CONTEXT]
                rows.append((doc_id, version, at, side, np.fromiter(map(zlib.crc32, near), np.uint32, len(near)).tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "version", "at", "side", "words"])


def _shared(a: bytes | None, b: bytes | None) -> int:
    x, y = np.frombuffer(a or b"", np.uint32), np.frombuffer(b or b"", np.uint32)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """All columns of `docs`, `text` without its repeated passages, and n_words, removed_words and removed_spans before it.

    Each passage of at least `least` words that repeats across documents stays in one of them. What is left of a text keeps
    its own characters; a removed passage takes the white space behind it along. Texts without repeats come back unchanged,
    null stays null. Rows with a null doc_id take no part and stay whole; rows that share doc_id and text are one document.
    An empty table gives an empty result. The columns n_words, removed_words and removed_spans replace any of those names.
    """
    spans = repeated_spans(docs, least).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "words")).alias("_spans"))
    known = docs.drop("n_words", "removed_words", "removed_spans")
    version = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    there = spans.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "_spans")
    both = known.withColumn("_version", version).join(there, (F.col("doc_id").cast("long") == F.col("_d")) & (F.col("_version") == F.col("_v")), "left").drop("_version", "_d", "_v")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, n_words, removed, n_spans = [], [], [], []
            for text, spans in zip(frame["text"], frame["_spans"], strict=True):
                text = text if isinstance(text, str) else None
                if spans is None or not len(spans):
                    n_words.append(len((text or "").encode("utf-8", "surrogatepass").split()))
                    texts.append(text), removed.append(0), n_spans.append(0)
                    continue
                left, gone, count, words = remove_words(text, [(s["start"], s["words"]) for s in spans])
                texts.append(left), removed.append(gone), n_spans.append(count), n_words.append(words)
            yield frame.drop(columns="_spans").assign(text=texts, n_words=n_words, removed_words=removed, removed_spans=n_spans)

    return both.mapInPandas(cut, f"{fields}, n_words int, removed_words int, removed_spans int")


def remove_words(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the (first word, number of words) spans; removed words, joined spans, words before."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)]
    bounds = [*starts, len(data)]
    merged: list[list[int]] = []
    for s, n in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s + n)
        else:
            merged.append([s, s + n])
    out, at = [], 0
    for s, e in merged:
        out.append(data[at : bounds[s]])
        at = bounds[min(e, len(starts))]
    left = b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
    return left, sum(min(e, len(starts)) - s for s, e in merged), len(merged), len(starts)
