"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy."""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import ascii_words, stored

# Words per window and between the starts of two windows: neighbours overlap by the difference.
WINDOW, STRIDE = 48, 40
HIDDEN, DIM, BUCKETS = 8, 8, 1 << 15
# Labelled rows the network is fitted on at most, of either class; chosen by the hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
EPOCHS, BATCH, SEED = 6, 48, 7
THRESHOLD = 0.3
_EDGES = b".,;:!?\"'()[]{}<>|%&$#*-_+=/\\~^`"
# Texts are read in portions of about so many characters, windows are run so many at once.
PORTION, RUN = 6_000_000, 1024


# masks of the first 3 to 8 bytes
_SPELLED = np.array([(1 << 8 * k) - 1 for k in range(3, 9)], np.uint64)


class Words:
    """Distinct words of a portion as inputs: one hashed word vector, the mean of the vectors of its
    hashed beginnings of 3 to 8 bytes, spelled one byte further each, and the greatest log-odds among these."""

    def __init__(self, words: list[bytes]):
        bare = [w.strip(_EDGES) for w in words]
        self.word = np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) % BUCKETS
        first = np.frombuffer(b"".join(w[:8].ljust(8, b"\0") for w in bare), "<u8")
        codes = first[:, None] & _SPELLED
        length = np.fromiter(map(len, bare), np.int64, len(bare))
        live = np.arange(3, 9) <= np.maximum(length, 3)[:, None]
        self.piece = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)[live]
        self.count = live.sum(axis=1)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(bare)), self.count)

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        pieces = np.add.reduceat(p["chars"][self.piece], self.start, axis=0) / self.count[:, None]
        strongest = np.maximum.reduceat(p["odds"][self.piece], self.start)
        return np.concatenate([p["words"][self.word], pieces.astype(np.float32), strongest[:, None]], axis=1)


def windows_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; per window its word numbers (WINDOW wide, -1 padded), in text order; the text each window is of; its length."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    rows, of = [], []
    for i, text in enumerate(texts):
        words = ascii_words(text)
        ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        n = max(1, -(-(len(ids) - (WINDOW - STRIDE)) // STRIDE))
        padded = np.full(n * STRIDE + WINDOW - STRIDE, -1, np.int32)
        padded[: len(ids)] = ids
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        of.append(np.full(n, i))
    windows = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32)
    return list(number), windows, np.concatenate(of) if of else np.zeros(0, np.int64), (windows >= 0).sum(axis=1)


# a sigmoid is a tanh of half the argument
_HALF = np.repeat(np.array([0.5, 1.0], np.float32), [2 * HIDDEN, HIDDEN])


def _tanh(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """tanh within 0.002 by a continued fraction, in a third of the time; the network is trained with it too."""
    x = np.clip(x, -3.646738, 3.646738, out=out)
    square = x * x
    below = square * np.float32(15)
    below += np.float32(420)
    below *= square
    below += np.float32(945)
    above = square + np.float32(105)
    above *= square
    above += np.float32(945)
    above *= x
    return np.divide(above, below, out=x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (_tanh(0.5 * x) + 1)


def _probability(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(p: dict[str, np.ndarray], gates: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logits of windows. gates: (2, words + 1, 3 * HIDDEN), the last row for padding, both directions' input terms."""
    b, h = len(windows), HIDDEN
    state = np.zeros((2, b, h), np.float32)
    hidden = np.empty((WINDOW, 2, b, h), np.float32)
    cache = []
    both = np.stack([windows, windows[:, ::-1]])
    for t in range(WINDOW):
        at = both[:, :, t]
        x = np.stack([gates[0][at[0]], gates[1][at[1]]])
        g = state @ p["U"]
        zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
        z, r = zr[..., :h], zr[..., h:]
        n = _tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
        live = (at >= 0)[..., None]
        new = np.where(live, n + z * (state - n), state)
        if keep:
            cache.append((state, z, r, n, g[..., 2 * h :], live))
        state = new
        hidden[t] = new
    # the backward direction read the window from its end
    joined = np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=-1)
    u = _tanh(joined @ p["A"])
    e = np.where(windows.T >= 0, u @ p["v"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, joined)
    logit = pooled @ p["o"] + p["c"][0]
    return (logit, (both, cache, joined, u, a, pooled)) if keep else logit


def backward(p, windows, kept, dlogit):
    """Gradients of the weights, and of the input terms by word: (2, words + 1, 3 * HIDDEN) as (positions, values)."""
    both, cache, joined, u, a, pooled = kept
    h = HIDDEN
    grad = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["o"]
    djoined = a[..., None] * dpooled
    da = np.einsum("tbh,bh->tb", joined, dpooled)
    de = a * (da - (a * da).sum(axis=0))
    grad["v"] = np.einsum("tb,tbk->k", de, u)
    du = de[..., None] * p["v"] * (1 - u * u)
    grad["A"] = np.einsum("tbh,tbk->hk", joined, du)
    djoined = djoined + du @ p["A"].T
    dhidden = np.stack([djoined[..., :h], djoined[::-1, :, h:]], axis=1)
    grad["U"] = np.zeros_like(p["U"])
    carry = np.zeros_like(dhidden[0])
    terms = np.empty((WINDOW, *carry.shape[:2], 3 * h), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        state, z, r, n, gn, live = cache[t]
        d = dhidden[t] + carry
        dm = np.where(live, d, 0)
        dn = dm * (1 - z) * (1 - n * n)
        dz = dm * (state - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        terms[t] = np.concatenate([dz, dr, dn], axis=-1)
        dg = np.concatenate([dz, dr, dn * r], axis=-1)
        grad["U"] += np.swapaxes(state, 1, 2) @ dg
        carry = np.where(live, dm * z, d) + dg @ np.swapaxes(p["U"], 1, 2)
    return grad, both, terms


def input_terms(p, inputs: np.ndarray) -> np.ndarray:
    return np.concatenate([inputs @ p["W"] + p["b"][:, None, :], np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)


def logits(p: dict[str, np.ndarray], gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The logits that `forward` gives, faster: windows without padding run with features in rows and no masks."""
    out = np.empty(len(windows), np.float32)
    whole = windows[:, -1] >= 0
    for rows in (np.flatnonzero(~whole), np.flatnonzero(whole)):
        full = len(rows) > 0 and whole[rows[0]]
        terms = gates * _HALF if full else gates
        for i in range(0, len(rows), RUN):
            some = rows[i : i + RUN]
            out[some] = _full_windows(p, terms, windows[some]) if full else forward(p, gates, windows[some])
    return out


def _full_windows(p, terms, windows) -> np.ndarray:
    h, b = HIDDEN, len(windows)
    weights = [np.ascontiguousarray((u * _HALF).T) for u in p["U"]]
    hidden = np.empty((WINDOW, 2 * h, b), np.float32)
    x, g, row = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32), np.empty((b, 3 * h), np.float32)
    at = np.ascontiguousarray(windows.T.astype(np.int64))
    for k in (0, 1):
        state = np.zeros((h, b), np.float32)
        for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
            np.take(terms[k], at[t], axis=0, out=row, mode="clip")
            x[:] = row.T
            np.matmul(weights[k], state, out=g)
            zr = x[: 2 * h]
            zr += g[: 2 * h]
            _tanh(zr, zr)
            zr += 1
            zr *= 0.5
            n = g[2 * h :]
            n *= zr[h:]
            n += x[2 * h :]
            _tanh(n, n)
            new = hidden[t, k * h : (k + 1) * h]
            np.subtract(state, n, out=new)
            new *= zr[:h]
            new += n
            state = new
    u = np.matmul(np.ascontiguousarray(p["A"].T), hidden)
    _tanh(u, u)
    e = np.tensordot(p["v"], u, axes=(0, 1))
    np.exp(e - e.max(axis=0), out=e)
    e /= e.sum(axis=0)
    score = np.tensordot(p["o"], hidden, axes=(0, 1))
    return (e * score).sum(axis=0) + p["c"][0]


def text_logits(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """The greatest logit over all windows of each text."""
    out = np.empty(len(texts), np.float64)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size < PORTION):
            size += len(texts[end] or "")
            end += 1
        words, windows, of, _ = windows_of(texts[start:end])
        gates = input_terms(p, Words(words).inputs(p) if words else np.zeros((0, 2 * DIM + 1), np.float32))
        found = logits(p, gates, windows)
        best = np.full(end - start, -np.inf)
        np.maximum.at(best, of, found)
        out[start:end] = best
        start = end
    return out


def train(texts: list[str | None], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Fit on whole texts: each step takes a text's highest-scoring window, and of clean texts a random one beside it.

    One coordinate of a word's vector starts at its shrunken log-odds, those of pieces are an input; all else starts at random.
    Toxic rows weigh as much as clean ones together. A fifth of the rows is held back for the slope and offset that turn
    logits into probabilities.
    """
    rng = np.random.default_rng(SEED)
    labels = labels.astype(np.float32)
    h, d = HIDDEN, 2 * DIM + 1
    small = lambda *shape: (rng.normal(size=shape) * 0.3 / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    p = {"words": (rng.normal(size=(BUCKETS, DIM)) * 0.05).astype(np.float32), "chars": (rng.normal(size=(BUCKETS, DIM)) * 0.05).astype(np.float32),
         "W": small(2, d, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "U": small(2, h, 3 * h), "A": small(2 * h, h), "v": small(h), "o": small(2 * h), "c": np.full(1, -1.0, np.float32)}
    # the first unit starts as a detector of strong log-odds that attention looks for
    for k, f in ((0, 0), (1, 0), (0, 2 * DIM), (1, 2 * DIM)):
        p["W"][k, f, 2 * h] += 0.7
    p["b"][:, 2 * h], p["b"][:, 0] = -1.4, -1.0
    p["A"][[0, h], 0] += 1.0
    p["v"][0] += 3.0
    p["o"][[0, h]] += 1.5
    held = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~held)
    words, windows, of, _ = windows_of(texts)
    known = Words(words)
    # log-odds of words and pieces over the fitted texts
    n_words = len(words)
    prior = labels[fit].mean()
    balance = (1 - prior) / prior
    for name, keys, owner in (("words", known.word, np.arange(n_words)), ("chars", known.piece, known.owner)):
        seen = np.zeros((2, BUCKETS))
        by_word = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[by_word], np.arange(n_words + 1))
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for i in fit:
            mine = np.unique(windows[bounds[i] : bounds[i + 1]])
            mine = mine[mine >= 0]
            spans = [keys[by_word[first[w] : first[w + 1]]] for w in mine]
            if spans:
                seen[int(labels[i])][np.unique(np.concatenate(spans))] += 1
        shrunk = (seen[1] + 5 * prior) / (seen.sum(axis=0) + 5)
        odds = (np.log(shrunk / prior) - np.log((1 - shrunk) / (1 - prior))).astype(np.float32)
        if name == "words":
            p["words"][:, 0] = odds
        else:
            p["odds"] = odds
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k not in ("words", "chars", "odds")}
    squares = {k: np.full((BUCKETS, 1), 1e-3, np.float32) for k in ("words", "chars")}
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            batch = fit[i : i + BATCH]
            spans = [np.arange(bounds[j], bounds[j + 1]) for j in batch]
            every = np.concatenate(spans)
            used, local = np.unique(windows[every], return_inverse=True)
            real = used[used >= 0]
            local = (local.reshape(len(every), WINDOW) - (len(used) - len(real))).astype(np.int32)
            some = _subset(known, real)
            inputs = some.inputs(p)
            gates = input_terms(p, inputs)
            score = logits(p, gates, local)
            rows, truth, at = [], [], 0
            for j, span in zip(batch, spans, strict=True):
                rows.append(at + int(np.argmax(score[at : at + len(span)])))
                truth.append(labels[j])
                if not labels[j] and len(span) > 1:
                    rows.append(at + int(rng.integers(len(span))))
                    truth.append(0.0)
                at += len(span)
            chosen, truth = local[rows], np.array(truth, np.float32)
            logit, kept = forward(p, gates, chosen, keep=True)
            grad, both, terms = backward(p, chosen, kept, (_probability(logit) - truth) * np.where(truth > 0, balance, 1) / len(truth))
            dgates = np.zeros_like(gates)
            for k in (0, 1):
                np.add.at(dgates[k], both[k].T.ravel(), terms[:, k].reshape(-1, 3 * h))
            dgates = dgates[:, :-1]
            grad["W"] = np.stack([inputs.T @ dgates[k] for k in (0, 1)])
            grad["b"] = dgates.sum(axis=1)
            dinputs = dgates[0] @ p["W"][0].T + dgates[1] @ p["W"][1].T
            step += 1
            for k, (m, s) in moments.items():
                m += 0.1 * (grad[k] - m)
                s += 0.001 * (grad[k] ** 2 - s)
                p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for k, keys, values in (("words", some.word, dinputs[:, :DIM]), ("chars", some.piece, (dinputs[:, DIM : 2 * DIM] / some.count[:, None])[some.owner])):
                distinct, place = np.unique(keys, return_inverse=True)
                total = np.zeros((len(distinct), DIM), np.float32)
                np.add.at(total, place, values)
                squares[k][distinct] += (total**2).mean(axis=1, keepdims=True)
                p[k][distinct] -= 0.02 * total / np.sqrt(squares[k][distinct])
    p["scale"] = np.array([1.0, -np.log(balance)])
    truth = labels[held]
    if 5 <= truth.sum() <= len(truth) - 5:
        p["scale"] = _calibrated(text_logits(p, [t for t, x in zip(texts, held, strict=True) if x]), truth)
    return p


def _subset(known: Words, which: np.ndarray) -> Words:
    some = Words.__new__(Words)
    some.word, some.count = known.word[which], known.count[which]
    some.start = np.concatenate([[0], np.cumsum(some.count)[:-1]]).astype(np.int64)
    some.owner = np.repeat(np.arange(len(which)), some.count)
    some.piece = known.piece[np.repeat(known.start[which] - some.start, some.count) + np.arange(some.count.sum())]
    return some


def _calibrated(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Slope and offset by Newton's method, drawn towards (1, 0) as if by a few further rows."""
    start = np.array([1.0, 0.0])
    w = start
    design = np.column_stack([np.clip(x, -12, 12), np.ones(len(x))])

    def loss(w):
        return np.logaddexp(0, np.where(truth > 0, -1, 1) * (design @ w)).sum() + ((w - start) ** 2).sum()

    for _ in range(30):
        q = _probability(design @ w)
        step = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + 2.0 * np.eye(2), design.T @ (q - truth) + 2.0 * (w - start))
        while loss(w - step) > loss(w) + 1e-9:
            step = step / 2
        w = w - step
    return w if w[0] > 0 else start


def fitted(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> dict:
    """The network's weights, or {"constant": share of toxic rows} where the labels hold one class only.

    Fitted in one task on at most `most_toxic` and `most_clean` labelled rows whose crc32(doc_id) mod 4 is not 2.
    """
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rank = F.xxhash64("doc_id")
    # each limit is a bound on the sample, kept while the rows are sorted
    bounded = [told.filter(test).orderBy(rank, "doc_id").limit(n) for test, n in ((F.col("toxic") > 0, most_toxic), (F.col("toxic") <= 0, most_clean))]
    chosen = bounded[0].unionByName(bounded[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        frame = pd.concat(rows, ignore_index=True)
        # by hash, so that either class meets every fifth row alike
        frame = frame.assign(o=[zlib.crc32(f"fit{i}".encode()) for i in frame["doc_id"]]).sort_values(["o", "doc_id"], kind="stable").drop_duplicates("doc_id")
        truth = (frame["toxic"].to_numpy() > 0).astype(np.float32)
        whole = frame["text"].where(frame["text"].notna(), "").tolist()
        model = {"constant": float(truth.mean())} if truth.min() == truth.max() else train(whole, truth)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = stored(sample).coalesce(1).mapInPandas(learn, "model binary").collect()  # one model of about 2 MB
    return pickle.loads(found[0]["model"]) if found else {"constant": 0.0}


def score(docs: DataFrame, model: dict, columns: tuple[str, ...] | None = None, name: str = "score") -> DataFrame:
    """`columns` of docs (all of them by default) with `name` in 0 to 1: the greatest over all overlapping windows of the whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    wanted = columns or tuple(docs.columns)
    read_also = wanted if "text" in wanted else (*wanted, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*wanted).schema.fields]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shipped.value
        for frame in frames:
            if "constant" in p:
                values = np.full(len(frame), p["constant"])
            else:
                slope, offset = p["scale"]
                values = _probability(slope * text_logits(p, [t if isinstance(t, str) else None for t in frame["text"]]) + offset)
            yield frame[list(wanted)].assign(**{name: values})

    return docs.select(*read_also).mapInPandas(read, f"{', '.join(fields)}, {name} double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with their columns."""
    return score(docs, fitted(docs, labels), name="_toxicity").filter(F.col("_toxicity") < threshold).select(*docs.columns)


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null and empty texts are one window without words, scored by the same network. Repeated rows get equal scores, a null
    doc_id is never held out. Labels that are null are left out; of several for one document the greatest counts. With one
    class of labels, or none, every score is the share of toxic labels. An empty table gives an empty result; no column
    but text enters a score.
    """
    scored = score(docs, fitted(docs, labels), ("doc_id",))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
