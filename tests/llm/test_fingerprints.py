"""Fingerprints, manifests and vector codes on odd rows, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import manifest as M
from crawlscope.llm import spotsigs as S
from crawlscope.llm import vector_codes as V
from crawlscope.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _bucket string, leaf string, root string, _tree string, fingerprint string"
CLASH = ("x", "y", "z", "t", "f")


def doc_rows(n=60, seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "und", "la", "is"]

    def text(k):
        return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(k))

    rows = [(i, text(rng.randint(1, 90)), rng.choice(["en", "de", "fr", "é", None]), rng.choice(["a", None, "bü"]), rng.choice([None, 5, 12345]), *CLASH) for i in range(n)]
    rows += [rows[4], rows[4], (None, "null id", None, None, None, *CLASH), (None, None, None, None, None, *CLASH), (None, "null id", "en", "a", 1, *CLASH),
             (200, None, "en", "a", 3, *CLASH), (201, "", "en", "", 3, *CLASH), (202, " \n ", "zz", "a", 3, *CLASH), (203, "na " * 30_000, "en", "a", 3, *CLASH),
             (204, text(20_000), "en", "a", 2**63 - 1, *CLASH), (205, "漢字" * 4000, "en", "a", -7, *CLASH), (206, "w" * 50_000, "en", "a", 1, *CLASH), (5, "same id", "en", "a", 1, *CLASH)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(5)


# --- fingerprints --------------------------------------------------------------------------------------


def plain_signatures(text):
    """Signatures as words: the same chains, found one by one."""
    words = S._WORD.findall((text or "").lower())
    out, since = set(), 0
    for i in range(-1, len(words)):
        if not words:
            break
        anchor = i < 0 or words[i] in S.ANCHORS
        since = 0 if anchor else since + 1
        if anchor or since % S.GAP == 0:
            chain = [w for w in words[i + 1 :] if w not in S.ANCHORS][: S.CHAIN]
            out.add(("^" if i < 0 else words[i], *chain))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("few", [1 << 23, 500])
def test_neighbours(spark, docs, few, monkeypatch):
    monkeypatch.setattr(S, "FEW_CHARS", few)  # one task, and many
    rows = [(r[0], r[1] or "") for r in doc_rows()]
    hashed = {t: h for t, h in spark.createDataFrame([(t,) for _, t in set(rows)], "t string").select("t", F.xxhash64("t")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = Counter()
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, e = map(plain_signatures, (text, after, new))
        want[d, len(text), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(a, e), 9), round(jaccard(a, b), 9)] += 1
    got = S.neighbours(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    by_text = dict(rows[::-1])
    assert all(len(S.read(r.fingerprint)) == len(plain_signatures(by_text[r.doc_id])) for r in got if Counter(d for d, _ in rows)[r.doc_id] == 1)
    signed = defaultdict(set)
    for r in S.fingerprints(docs).collect():
        signed[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in signed.values())


def test_a_lone_row_and_none(spark):
    one = S.neighbours(spark.createDataFrame([(1, "the quick fox of a wood", 0)], "doc_id long, text string, n_chars int")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(1, 23, 1.0)]
    assert S.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruned_likeness_is_the_likeness_where_it_reaches_the_least():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.choice(5000, rng.integers(2, 3000), replace=False).astype(np.uint64)
        a, b = (np.sort(pool[rng.random(len(pool)) < rng.uniform(0.2, 1)]) for _ in range(2))
        exact = jaccard(set(a.tolist()), set(b.tolist()))
        for least in (0.0, 0.5, 0.8):
            assert math.isclose(S.likeness(a, b, least), exact if exact >= least else 0.0)
        if exact > 0.8 and len(a) and len(b):
            assert abs(S.length_class(len(a), 0.8) - S.length_class(len(b), 0.8)) <= 1
    assert np.array_equal(S.read(S.written(np.array([1, 2**48 - 1], np.uint64))), [1, 2**48 - 1])


# --- manifest ------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([H(*d[i : i + 2]) for i in range(0, len(d), 2)])
    return levels


def path(levels, i):
    """(sibling or None, stands left) from the leaf up."""
    out = []
    for d in levels[:-1]:
        out.append((d[i ^ 1] if i ^ 1 < len(d) else None, bool(i & 1)))
        i >>= 1
    return out


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def plain_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(tree([leaf_of(r) for r in by_lang[lang]]))
    top = tree([t[-1][0] for t in trees])
    out = Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            steps = [*path(trees[k], i), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf_of((*r[:4], r[4] + 1)) if bad else leaf_of(r)
            for s, left in steps:
                h = H(h) if s is None else H(s, h) if left else H(h, s)
            out[r[0], leaf_of(r), trees[k][-1][0], top[-1][0], H(*[s for s, _ in steps if s]), h, h == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("bits,part_rows", [(10, 16_384), (2, 9)])
def test_manifest(spark, docs, monkeypatch, tmp_path, bits, part_rows):
    monkeypatch.setattr(M, "BITS", bits)
    monkeypatch.setattr(M, "PART_ROWS", part_rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_octopus_multiproof"](spark, str(tmp_path))
    want = plain_manifest(doc_rows())
    assert Counter(map(tuple, got.collect())) == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert M.manifest(spark.createDataFrame([], schema)).count() == 0
    row = M.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], schema)).collect()[0]
    assert (row.leaf, row.proof, row.verified) == (row.root, "", True) and row.subroot == row.root == H("1:11:s2:en1:22:ab")


def test_missing_nodes_are_enough_and_none_is_needless():
    rng = random.Random(7)
    for _ in range(200):
        size = rng.randint(1, 40)
        held = rng.sample(range(size), rng.randint(1, size))
        known = {(0, p) for p in held}
        asked = M.missing(held, size)
        assert not known & set(asked) and len(asked) == len(set(asked))

        def root(given):
            level, width, here = 0, size, {p for lv, p in given if lv == 0}
            while width > 1:
                here = {p >> 1 for p in here if p % 2 == 1 and p - 1 in here or p % 2 == 0 and (p + 1 in here or p + 1 >= width)}
                level, width = level + 1, (width + 1) // 2
                here |= {p for lv, p in given if lv == level}
            return 0 in here

        assert root(known | set(asked))
        assert all(not root((known | set(asked)) - {a}) for a in asked)


# --- vector codes --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, _row int"


def plain_codes(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))
    width = len(named[0][1])
    seeds = [r for r in named if len(r[1]) == width][:entries]
    whole = [[math.floor(1024 * v) for v in r[1]] for r in kept if len(r[1]) == width]
    cut = [[x[p * width // 4 : (p + 1) * width // 4] for x in whole] for p in range(4)]
    books = [[[math.floor(1024 * v) for v in s[1]][p * width // 4 : (p + 1) * width // 4] for s in seeds] for p in range(4)]
    for t in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])) for x in cut[p]] for p in range(4)]
        if t < rounds:
            for p in range(4):
                for j in range(len(books[p])):
                    mine = [x for x, (_, k) in zip(cut[p], near[p]) if k == j]
                    if mine:
                        books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    sums, out, i = Counter(), [], 0
    for r in kept:
        if len(r[1]) != width:
            out.append((r[0], r[2], None, None))
            continue
        out.append((r[0], r[2], "".join(f"{near[p][i][1]:02x}" for p in range(4)), sum(near[p][i][0] for p in range(4))))
        sums[r[2]] += out[-1][3]
        i += 1
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((v, code, error, sums.get(label), digest) for v, label, code, error in out)


def vector_rows(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    rows = [(i, [float(v) for v in centres[i % 30] + rng.normal(size=width) * spread], int(i % 4) or None, "c", "e", 1) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1, "c", "e", 1), (n + 1, None, 1, "c", "e", 1), (n + 2, [None, *rows[0][1][1:]], 1, "c", "e", 1),
             (n + 3, [math.nan, *rows[0][1][1:]], 1, "c", "e", 1), (n + 4, [math.inf, *rows[0][1][1:]], 2, "c", "e", 1), (n + 5, [], None, "c", "e", 1), (n + 6, [1.0, 2.0], 9, "c", "e", 1),
             (-1, rows[7][1], 2, "c", "e", 1)]
    return rows


@pytest.mark.parametrize("n,width,step", [(700, 8, 4096), (700, 12, 50), (40, 8, 7)])
def test_codes(spark, monkeypatch, n, width, step):
    monkeypatch.setattr(V, "STEP", step)
    rows = vector_rows(n, width, n + width)
    got = V.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)
    if n > 300:
        assert got[0].computed_share < 0.8  # bounds spare distances


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert V.compress(empty).count() == 0
    unnamed = V.compress(spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], 1, "", "", 1)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error) for r in unnamed] == [(None, None, None)]
    blank = V.compress(spark.createDataFrame([(1, [], 1, "", "", 1)], VECTORS)).collect()
    assert [(r.code, r.error) for r in blank] == [("00000000", 0)]
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1e30, 2.0, 3.0, 4.0], 1, "", "", 1)], VECTORS))


def test_net_displacement_is_never_wider_than_the_sum_of_moves():
    rng = np.random.default_rng(0)
    history = [rng.integers(-100, 100, (32, 6))]
    for _ in range(4):
        history.append(history[-1] + rng.integers(-9, 10, (32, 6)))
    groups = np.arange(32) // V.GROUP
    net = V.displacement(history, groups)
    single = [V.displacement(history[t : t + 2], groups)[0] for t in range(4)]
    assert all((net[s] <= np.sum(single[s:], axis=0) + 1e-9).all() for s in range(4)) and (net[0] < np.sum(single, axis=0)).all()
