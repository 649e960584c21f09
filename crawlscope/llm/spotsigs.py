"""Document fingerprints from chains of content words that follow common words.

An anchor is one of a few common words, the beginning of a text, or, where content words run on without any, every GAP-th of them.
The anchor and the next CHAIN content words make a signature; a text's fingerprint is the set of its signatures. Function words
between content words change nothing, and an edit changes only the chains that meet it.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import stored

# Common function words of four languages.
ANCHORS = frozenset((
    "the of and to a in is that it for was on with as be by this are at from or an not but have had his her they which "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au il elle plus son ce se "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an werden aus er hat dass sie "
    "el y los las del por con no su una para al lo como más pero sus le ya o fue este ha sí porque esta").split())
CHAIN = 2
GAP = 8
# Bytes of a signature in a fingerprint, 8 characters of base64.
BYTES = 6
# Characters that one task orders and compares on average, where the input is large enough to give every core some.
TASK_CHARS = 1 << 27
FEW_CHARS = 1 << 23
SOME_TASKS = 256
# Words whose hashes a task remembers at once, and characters it gives out at once.
REMEMBERED = 1 << 16
OUT_CHARS = 1 << 23

_WORD = re.compile(r"[^\W_]+")
_START, _END = np.uint64(xxhash.xxh3_64_intdigest(b"^ start") | 1), np.uint64(xxhash.xxh3_64_intdigest(b"$ end") & ~1)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Signer:
    """Signature sets of texts; hashes of words are remembered up to a fixed number."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        # the lowest bit tells anchors from content words
        h = xxhash.xxh3_64_intdigest(word.encode()) & ~1 | (word in ANCHORS)
        self.known[word] = h
        return h

    def signatures(self, text: str) -> np.ndarray:
        """The sorted set of signatures, 48 bits each; empty for a text without letters or digits."""
        known = self.known
        words = [known.get(w) or self._hash(w) for w in _WORD.findall(text.lower())]
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([_START, *words], dtype=np.uint64)
        anchor = (h & np.uint64(1)).astype(bool)
        places = np.arange(len(h))
        since = places - np.maximum.accumulate(np.where(anchor, places, 0))
        at = np.flatnonzero(anchor | (since % GAP == 0))
        content = np.flatnonzero(~anchor)
        following = np.concatenate([h[content], np.full(CHAIN, _END)])
        first = np.searchsorted(content, at, side="right")
        mixed = h[at] * _MIX[0]
        for i in range(CHAIN):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1] + following[first + i] * _MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[3]
        return np.unique(mixed >> np.uint64(64 - 8 * BYTES))


def written(signatures: np.ndarray) -> str:
    """A set as text: signatures in ascending order, 8 characters each."""
    return base64.b64encode(signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BYTES)
    return np.concatenate([np.zeros((len(raw), 8 - BYTES), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def length_class(n: int, least: float) -> int:
    """Partition of a set by its length: sets two or more partitions apart are less alike than `least`."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(least))) if 0 < least < 1 else 0


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 as soon as it is known to be below `least`, which 0 never is.

    Two empty sets are alike (1), an empty and another one are not (0). Partitions of length are compared first, then the
    lengths, then the sets piece by piece, as long as what is left could still reach `least`.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if abs(length_class(len(a), least) - length_class(len(b), least)) > 1 or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common, i, j = 0, 0, 0
    while i < len(a) and j < len(b):
        end = min(a[min(i + 512, len(a)) - 1], b[min(j + 512, len(b)) - 1])
        i_end, j_end = i + int(np.searchsorted(a[i:], end, "right")), j + int(np.searchsorted(b[j:], end, "right"))
        common += len(np.intersect1d(a[i:i_end], b[j:j_end], assume_unique=True))
        i, j = i_end, j_end
        reach = common + min(len(a) - i, len(b) - j)
        if reach < least * (len(a) + len(b) - reach):
            return 0.0
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as much from the beginning of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """`docs` with a column of fingerprints, which replaces one of that name; a null text counts as empty."""
    @F.pandas_udf("string")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer()
        for series in texts:
            yield series.map(lambda t: written(signer.signatures(t or "")))

    return docs.withColumn(fingerprint, signed(F.col(text)))


ORDER = ["_null", "_down", "_hash"]


def _compared(least: float):
    """Rows in order, each bucket ended by a guest, the first row of the next bucket."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        last = None  # bucket, doc_id, text, signatures, fingerprint
        done = None  # texts and results of the pair before: copies need no second look
        out: list[tuple] = []
        held = 0
        for frame in frames:
            for bucket, guest, doc_id, text in zip(frame["_bucket"], frame["_guest"], frame["_doc"], frame["_text"]):
                if last is not None and last[2] == text:
                    signs, sign = last[3:]
                elif guest and last is None:
                    continue  # a copy of the guest
                else:
                    signs = signer.signatures(text)
                    sign = written(signs)
                if last is not None:
                    if done is None or done[0] != last[2] or done[1] != text:
                        new = edited(last[2], text)
                        new_signs = signer.signatures(new)
                        done = (last[2], text, (
                            len(last[2]), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[4], written(new_signs),
                            likeness(last[3], new_signs, least), likeness(last[3], signs, least)))
                    out.append((last[1], *done[2]))
                    held += len(done[2][2]) + len(done[2][3]) + 100
                last = None if guest else (bucket, doc_id, text, signs, sign)
                if held > OUT_CHARS:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def neighbours(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Per row of `docs` (doc_id, text): the length and fingerprint of its text, its text edited with the next one's, and how alike
    its fingerprint is to the edited text's and to the next text's.

    Rows go by descending doc_id, nulls last, rows of one doc_id by a hash of their text; the last is followed by the first, and a
    lone row by itself. A null text counts as empty; texts without words have the empty fingerprint, and two such are alike. Repeated
    rows each give a row. An empty table gives no rows; other columns are ignored, whatever their names.

    Bounds of the sorted order are read from a narrow copy, one per task; each task's rows then come with the first row of the
    next task, so no row travels twice but those at the bounds.
    """
    number = F.col("doc_id").cast("long")
    rows = docs.select(
        F.col("doc_id").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.when(number.isNull(), 1).otherwise(0).alias("_null"),
        F.coalesce(F.bitwise_not(number), F.lit(0).cast("long")).alias("_down")).withColumn("_hash", F.xxhash64("_text"))
    narrow = stored(rows.select(*ORDER, F.length("_text").cast("long").alias("_chars")))
    chars = narrow.agg(F.sum("_chars")).first()[0] or 0
    tasks = max(1, -(-chars // TASK_CHARS), min(SOME_TASKS, -(-chars // FEW_CHARS)))
    ranges = narrow.repartitionByRange(tasks, *ORDER).withColumn("_part", F.spark_partition_id())
    first = ranges.groupBy("_part").agg(F.min(F.struct(*ORDER)).alias("_first"))
    bounds = sorted(tuple(r["_first"]) for r in first.collect())  # one per task

    @F.pandas_udf("array<struct<bucket:int,guest:boolean>>")
    def dealt(null: pd.Series, down: pd.Series, hashed: pd.Series) -> pd.Series:
        out = []
        for key in zip(null, down, hashed):
            b = bisect_right(bounds, key) - 1
            out.append([(b, False), ((b - 1) % len(bounds), True)] if bounds[b] == key else [(b, False)])
        return pd.Series(out)

    placed = rows.select("*", F.inline(dealt(*ORDER)).alias("_bucket", "_guest"))
    line = placed.repartition(len(bounds) or 1, "_bucket").sortWithinPartitions("_bucket", "_guest", *ORDER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return line.select("_bucket", "_guest", "_doc", "_text").mapInPandas(
        _compared(least), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
