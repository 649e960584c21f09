"""Packing token pieces into sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import stored

LENGTH = 2048
END_ID = 1
# Segments one sequence may hold; attention masks and position resets are stored per segment.
SEGMENTS = 512
# Pieces packed together by one call on average.
GROUP_ROWS = 20_000
# Distinct words whose ids a task remembers before it starts afresh; a cache, nothing is left out.
REMEMBERED = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"
# White space on both sides of a space, or separators that the libraries class differently: such texts are encoded in one go.
_TOGETHER = re.compile(r"\s \s|^ |[\x1c-\x1f\x85᠎​﻿]|<\|endoftext\|>")


# How a byte-level file spells bytes that do not print, and where it cuts words.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
class _Words(dict[str, bytes]):
    """word -> its ids as little-endian unsigned 32-bit numbers; unknown words are encoded when they are asked for."""

    def __init__(self, quick: Callable[[str], list[int]]):
        self.quick = quick

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = struct.pack(f"<{len(found := self.quick(word))}I", *found)
        return ids


_WORDS: dict[str, _Words] = {}


def _word_encoder(path: str) -> Callable[[str], list[int]] | None:
    """The ranks of the same file for `tiktoken`, several times faster on single words; None if the file's merges don't rise by id."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
    if not plain or made != sorted(made):
        return None
    rest = iter(range(256, 512))
    spelled = {chr(b) if b in _PRINTED else chr(next(rest)): b for b in range(256)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(spelled[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_bpe_encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the `tokenizers` file, special tokens in the text included, without added ones.

    A space always starts a new pre-token, so a text is cut there and each distinct word is encoded once; texts where a
    space meets other white space, or with a special token, go through the library whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    quick = _word_encoder(path)
    known = _WORDS.setdefault(path, _Words(quick)) if quick else {}

    def encode(text: str) -> np.ndarray:
        if quick is None or "\0" in text or _TOGETHER.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(known) > REMEMBERED:
            known.clear()
        return np.frombuffer(b"".join(map(known.__getitem__, text.replace(" ", "\0 ").split("\0"))), "<u4")

    return encode


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """Cut every document (ids, then END_ID) into pieces of `length` and a rest; the ids leave the task as a checksum only."""
    path = tokenizer or public_path()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe_encoder(path)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                rows += [(doc_id, at, len(part := ids[at : at + length]), zlib.crc32(part.tobytes()), len(ids), len(part)) for at in range(0, len(ids), length)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    named = docs.select(F.col(columns[0]).cast("long").alias("doc_id"), F.col(columns[1]).alias("text"))
    return named.mapInPandas(cut, PIECES)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin's order of each row of `sizes` (rows by dimensions), for simultaneous `limits`.

    One bin at a time: of the distinct vectors that still fit, the one with the greatest dot product with the remaining
    room, both scaled by the limits and the room weighted by what the waiting rows still demand, is placed next.
    """
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    order = np.argsort(kind_of, kind="stable")
    counts = np.bincount(kind_of, minlength=len(kinds))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    used = np.zeros(len(kinds), np.int64)
    scaled = kinds / limits
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    live = np.arange(len(kinds))
    weight = scaled.T @ counts
    bin_id = 0
    while len(live):
        room, place, here = limits.astype(np.int64).copy(), 0, live
        while True:
            fits = (kinds[here] <= room).all(axis=1) & (used[here] < counts[here])
            here = here[fits]
            if not len(here):
                break
            best = here[np.argmax(scaled[here] @ (weight * (room / limits)))]
            row = order[starts[best] + used[best]]
            bins[row], places[row] = bin_id, place
            used[best] += 1
            room = room - kinds[best]
            place += 1
        if place == 0:
            raise ValueError("an item exceeds the limits")
        live = live[used[live] < counts[live]]
        bin_id += 1
    return bins, places


def pack(pieces: DataFrame, limits: dict[str, int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` with sequence_id and offset: no sequence exceeds any of `limits` (column -> limit; "segments" counts rows).

    Pieces are hashed to groups of about `group_rows` that are packed apart, so the work divides over tasks; each group
    leaves one badly filled sequence at most. Columns `doc_id`, `start` and `length` name a piece and give its offset.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_rows))
    names, most = list(limits), np.array(list(limits.values()), float)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema.fields)}, sequence_id long, offset long"

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame.pop("_group").iloc[0])
        frame = frame.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
        sizes = np.column_stack([np.ones(len(frame), np.int64) if c == "segments" else frame[c].to_numpy(np.int64) for c in names])
        bins, places = dot_product_bins(sizes, most)
        frame["sequence_id"] = bins + (group << 32)
        frame["_place"] = places
        frame = frame.sort_values(["sequence_id", "_place"], kind="stable").drop(columns="_place")
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, segments: int = SEGMENTS) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens, `segments` pieces and `length` loss-bearing tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are the end token alone; rows
    with equal or null doc_id are packed as rows of their own; an empty table gives an empty result; other columns are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer, length))
    return pack(pieces, {"length": length, "segments": segments, "loss_tokens": length}).drop("loss_tokens")
