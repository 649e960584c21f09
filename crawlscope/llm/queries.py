"""The subpackage's queries over whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_entropy_mix")
def entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op8_best_fit_shards")
def best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.sharding import shard_evenly

    return shard_evenly(table(spark, sf_dir, "documents"))


@query("op10_vector_packing")
def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op6_tag_path_ratios")
def tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages"))


TOP_K_SQL = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM sound q JOIN sound c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_no_random_access", TOP_K_SQL)
def no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.topk import inner_product_top_k

    return inner_product_top_k(table(spark, sf_dir, "embeddings"))


@query("op9_recurrent_toxicity")
def recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM reach r JOIN edges e ON e.b = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@query("op3_ngram_jaccard_join", NGRAM_SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.ngram_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op2_chunk_dedup")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_words", "removed_words", "removed_spans")


@query("op1_nn_descent")
def nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.language_model import score_texts

    return score_texts(table(spark, sf_dir, "documents"))

MANIFEST_SQL = """
WITH RECURSIVE framed AS (
    SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
        xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
            lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
            lambda c, b: xor(xor(c, b) // 2, (xor(c, b) % 2) * 3988292384)), 4294967295) AS crc FROM documents
), leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM framed
), places AS MATERIALIZED (
    SELECT *, row_number() OVER () AS copy, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS width FROM leaves
), trees AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang
), low(tree, level, place, width, h) AS (
    SELECT tree, 0, place, width, leaf FROM places JOIN trees ON places.lang IS NOT DISTINCT FROM trees.lang
    UNION ALL
    SELECT tree, level + 1, place // 2, (width + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE width > 1 GROUP BY tree, level, place // 2, width
), subroots AS (SELECT tree, h FROM low WHERE width = 1
), high(level, place, width, h) AS (
    SELECT 0, tree, (SELECT count(*) FROM subroots), h FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, (width + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE width > 1 GROUP BY level, place // 2, width
), steps AS (
    SELECT tree, level, place, width, h FROM low WHERE width > 1
    UNION ALL
    SELECT s.tree, (SELECT count(*) FROM low l WHERE l.tree = s.tree AND l.place = 0 AND l.width > 1) + u.level, u.place, u.width, u.h
    FROM subroots s CROSS JOIN high u WHERE u.width > 1
), walk(doc_id, copy, tree, level, place, h, proof) AS (
    SELECT doc_id, copy, tree, 0, place, coalesce(tampered, leaf), ''
    FROM places JOIN trees ON places.lang IS NOT DISTINCT FROM trees.lang
    UNION ALL
    SELECT w.doc_id, w.copy, w.tree, w.level + 1, w.place // 2,
        sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.place % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
    FROM (SELECT w.doc_id, w.copy, w.tree, w.level, w.h, w.proof, CASE WHEN w.level = d.depth THEN w.tree ELSE w.place END AS place
          FROM walk w JOIN (SELECT tree, max(level) AS depth FROM low GROUP BY tree) d ON d.tree = w.tree) w
    JOIN (SELECT tree, level FROM steps GROUP BY tree, level) more ON more.tree = w.tree AND more.level = w.level
    LEFT JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1)
), ended AS (SELECT copy, max_by(h, level) AS folded, max_by(proof, level) AS proof FROM walk GROUP BY copy
), starts AS (SELECT copy, doc_id, leaf, tree FROM places JOIN trees ON places.lang IS NOT DISTINCT FROM trees.lang)
SELECT s.doc_id, s.leaf, r.h AS subroot, (SELECT h FROM high WHERE width = 1) AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
    e.folded = (SELECT h FROM high WHERE width = 1) AS verified
FROM starts s JOIN ended e ON e.copy = s.copy JOIN subroots r ON r.tree = s.tree
"""


@query("op12_octopus_multiproof", MANIFEST_SQL)
def octopus_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.manifest import manifest

    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, one_more).otherwise(F.col("n_chars").cast("string"))
    return manifest(table(spark, sf_dir, "documents"), {"n_chars": tampered}).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as two steps, nearest entries and new codebooks, over (part, place in part, component) rows."""
    steps = [f"""
WITH sound AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (SELECT n, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM sound, range({parts}) AS r(p)
), book0 AS MATERIALIZED (SELECT p, n - 1 AS j, x AS c FROM pieces WHERE n <= {entries})"""]
    for t in range(rounds + 1):
        steps.append(f"""
near{t} AS MATERIALIZED (
    SELECT n, p, min(d) AS d, min_by(j, d * {entries} + j) AS j FROM (
        SELECT n, q.p, j, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces q JOIN book{t} b ON b.p = q.p)
    GROUP BY n, p)""")
        if t < rounds:
            steps.append(f"""
book{t + 1} AS MATERIALIZED (
    SELECT b.p, b.j, coalesce(list(floor(s / k)::BIGINT ORDER BY i) FILTER (s IS NOT NULL), any_value(b.c)) AS c FROM book{t} b LEFT JOIN (
        SELECT p, j, i, sum(x[i])::DOUBLE AS s, count(*) AS k FROM near{t} JOIN pieces USING (n, p), range(1, len(x) + 1) AS r(i) GROUP BY p, j, i) m
    ON m.p = b.p AND m.j = b.j GROUP BY b.p, b.j)""")
    return ",".join(steps) + f"""
SELECT vec_id, lower(string_agg(printf('%02x', j), '' ORDER BY p)) AS code, sum(d)::BIGINT AS error,
    (sum(sum(d)) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM book{rounds}) AS codebooks_sha256
FROM near{rounds} JOIN sound USING (n) GROUP BY n, vec_id, label
"""


@query("op13_norm_of_sum_codes", _codes_sql())
def norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op11_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crawlscope.llm.spotsigs import neighbours

    return neighbours(table(spark, sf_dir, "documents"))
