"""Query and page performance, scores over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope.catalog.fixtures import crawl, load
from crawlscope.catalog.registry import query
from crawlscope.catalog.text_queries import sql_bucket, sql_canonical
from crawlscope.operators import competitors as R
from crawlscope.operators import links as L
from crawlscope.operators import scores as S
from crawlscope.operators import search as Q
from crawlscope.session import scratch, written
from crawlscope.sinks.current import History

CURRENT = """(SELECT s.* FROM {search_rows} s
  JOIN (SELECT project_id, max(date) AS newest FROM {search_rows} m GROUP BY 1) n ON s.project_id = n.project_id AND s.date = n.newest)"""


def rows(spark, sf):
    """Search rows as they lie on disk: looking for the newest ones reads them three times, and building them joins and sums."""
    return written(load(spark, sf, "search_rows"))


@query("latest_rows", f"SELECT project_id, CAST(date AS STRING) AS date, query, page, clicks, impressions, position FROM {CURRENT} c")
def latest(spark, sf):
    return Q.current(rows(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("totals_last_28_days", """
    SELECT d.project_id, sum(clicks) AS clicks, sum(impressions) AS impressions, round(avg(position), 6) AS avg_position
    FROM {daily_rows} d JOIN (SELECT project_id, max(date) AS newest FROM {daily_rows} m GROUP BY 1) n
      ON d.project_id = n.project_id AND d.date > n.newest - 28
    GROUP BY 1""")
def totals(spark, sf):
    return Q.totals_last_n_days(load(spark, sf, "daily_rows")).withColumn("avg_position", F.round("avg_position", 6))


CTR_CURVE = f"""SELECT project_id, {sql_bucket('position')} AS bucket, count(*) AS keywords, sum(impressions) AS impressions, sum(clicks) AS clicks,
    round_even(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 4) AS ctr FROM {CURRENT} c WHERE position IS NOT NULL GROUP BY 1, 2"""


@query("ctr_curve", CTR_CURVE)
def ctr_curve(spark, sf):
    return Q.ctr_curve(rows(spark, sf))


def history(spark, sf):
    """The rows landed window by window: all of them with half of the clicks, then all, then the newer ones again."""
    kept = History(spark, scratch(spark))
    found = rows(spark, sf)
    newer = found.filter("date >= DATE '1996-01-01'")
    for window in (found.withColumn("clicks", F.floor(F.col("clicks") / 2)), found, newer):
        kept.land(window)
    return kept


@query("history_ctr_curve", CTR_CURVE)
def history_ctr_curve(spark, sf):
    return Q.ctr_curve(history(spark, sf))


@query("history_latest_rows", f"SELECT project_id, CAST(date AS STRING) AS date, query, page, clicks, impressions, position FROM {CURRENT} c")
def history_latest(spark, sf):
    return Q.current(history(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("ctr_summary", f"""
    SELECT project_id, sum(clicks) AS total_clicks, sum(impressions) AS total_impressions,
           round_even(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 4) AS site_ctr, sum(clicks) >= 30 AS reliable,
           CASE WHEN sum(clicks) < 30 THEN 'Only ' || sum(clicks) || ' clicks loaded, 30 needed to compare keywords' END AS note
    FROM {CURRENT} c GROUP BY 1""")
def ctr_summary(spark, sf):
    return Q.ctr_summary(rows(spark, sf))


@query("never_clicked", f"""
    SELECT project_id, query, page, round_even(position, 1) AS position, impressions FROM {CURRENT} c
    WHERE position <= 10 AND impressions >= 30 AND clicks = 0""")
def never_clicked(spark, sf):
    return Q.never_clicked(rows(spark, sf))


@query("top10_zero_ctr", f"""
    SELECT project_id, 'high' AS severity, 'meta' AS category,
           chr(39) || query || chr(39) || ': position ' || round_even(position, 1) || ', ' || impressions || ' impressions, 0 clicks' AS title,
           nullif(page, '') AS page_url, NULL AS current_text, NULL AS suggested_text, '5min' AS effort, 5 AS impact
    FROM {CURRENT} c WHERE position <= 10 AND clicks = 0 AND impressions >= 5""")
def zero_ctr(spark, sf):
    return Q.top10_zero_ctr(rows(spark, sf))


def _ranked(source: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT project_id, query, page, clicks, impressions, position,
        row_number() OVER (PARTITION BY project_id ORDER BY impressions DESC, query, page NULLS FIRST) AS rank FROM {source} c) r WHERE rank <= {k}"""


_OUT = ["project_id", "query", "page", "clicks", "impressions", "position", "rank"]


@query("rankings_filter", f"""SELECT project_id, query, page, clicks, impressions, position FROM {CURRENT} c
    WHERE query ILIKE '%RING%' AND position >= 2 AND position <= 30""")
def rankings(spark, sf):
    return Q.rankings_filter(rows(spark, sf), "RING", 2.0, 30.0).select(*_OUT[:-1])


@query("near_top10", _ranked(f"(SELECT * FROM {CURRENT} c WHERE position > 10 AND position <= 20)", 5))
def near(spark, sf):
    return Q.near_top10(rows(spark, sf)).select(*_OUT)


@query("top_rows", _ranked(CURRENT, 1000))
def top_rows(spark, sf):
    return Q.top_rows(Q.current(rows(spark, sf)), 1000).select(*_OUT)


@query("top_queries", _ranked(CURRENT, 10))
def top_queries(spark, sf):
    return Q.top_queries(rows(spark, sf)).select(*_OUT)


@query("top_keywords", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY impressions DESC, query) AS rank
      FROM (SELECT project_id, query, max(impressions) AS impressions FROM {CURRENT} c GROUP BY 1, 2) g) r WHERE rank <= 20""")
def top_keywords(spark, sf):
    return Q.top_keywords(rows(spark, sf), 20)


@query("top_keywords_without_brand", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY impressions DESC, query) AS rank
      FROM (SELECT project_id, query, max(impressions) AS impressions FROM {CURRENT} c
            WHERE NOT contains(query, 'gear') AND NOT contains(query, 'old') GROUP BY 1, 2) g) r WHERE rank <= 20""")
def top_keywords_without_brand(spark, sf):
    brands = load(spark, sf, "sites").select("project_id", F.lit("Óld Gear xy").alias("name"))
    return Q.top_keywords(rows(spark, sf), 20, brands)


@query("speed_targets", f"""
    WITH per_page AS (SELECT project_id, page, sum(impressions) AS n, {sql_canonical('page')} AS c FROM {CURRENT} c WHERE page IS NOT NULL GROUP BY 1, 2),
    shown AS (SELECT project_id, c, sum(n) AS n, arg_min(page, (-n, page)) AS page FROM per_page GROUP BY 1, 2),
    listed AS (SELECT project_id, {sql_canonical('url')} AS c, url AS page, 0 AS tier, 0 AS n FROM {{sites}} s UNION ALL SELECT project_id, c, page, 1, -n FROM shown),
    once AS (SELECT *, row_number() OVER (PARTITION BY project_id, c ORDER BY tier, n, page) AS k FROM listed)
    SELECT * FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY tier, n, page) AS rank, page AS url FROM once WHERE k = 1) t WHERE rank <= 6""")
def speed_targets(spark, sf):
    return Q.speed_targets(rows(spark, sf), load(spark, sf, "sites"), 6)


@query("merged_keyword_list", f"""
    WITH both_lists AS (
      SELECT project_id, query AS keyword, 0 AS tier, -max(impressions) AS shown FROM {CURRENT} c GROUP BY 1, 2
      UNION ALL SELECT project_id, keyword, 1, 0 FROM {{keyword_rows}} k WHERE source = 'trends_related'),
    once AS (SELECT *, row_number() OVER (PARTITION BY project_id, keyword ORDER BY tier, shown) AS k FROM both_lists)
    SELECT * FROM (SELECT project_id, keyword, row_number() OVER (PARTITION BY project_id ORDER BY tier, shown, keyword) AS rank FROM once WHERE k = 1) r
    WHERE rank <= 400""")
def merged(spark, sf):
    return Q.merged_keyword_list(rows(spark, sf), load(spark, sf, "keyword_rows"), 400)


@query("keywords_view", f"""
    WITH v AS (SELECT project_id, keyword, arg_max(volume, last_updated) AS trend_volume FROM {{keyword_rows}} k WHERE source = 'trends' GROUP BY 1, 2),
    i AS (SELECT project_id, keyword, arg_max(intent, last_updated) AS intent FROM {{keyword_rows}} k WHERE intent IS NOT NULL GROUP BY 1, 2)
    SELECT c.project_id, query, page, position, clicks, impressions, trend_volume, intent FROM {CURRENT} c
    LEFT JOIN v ON v.project_id = c.project_id AND v.keyword = query LEFT JOIN i ON i.project_id = c.project_id AND i.keyword = query""")
def keywords_view(spark, sf):
    return Q.keywords_view(rows(spark, sf), load(spark, sf, "keyword_rows"))


def _zero(page: str, url: str) -> str:
    return f"""
    SELECT p.project_id, 'medium' AS severity, 'pruning' AS category, p.url || ': no impressions in the loaded window' AS title,
           p.url AS page_url, NULL AS current_text, 'Check the full window before removing anything' AS suggested_text, '1h' AS effort, 1 AS impact
    FROM {{crawl_flat}} p LEFT JOIN (SELECT project_id, {page} AS page, sum(impressions) AS n FROM {CURRENT} c WHERE page IS NOT NULL GROUP BY 1, 2) s
      ON s.project_id = p.project_id AND s.page = {url}
    WHERE is_indexable AND coalesce(n, 0) = 0"""


@query("zero_impression_pages", _zero("page", "p.url"))
def zero_impressions(spark, sf):
    return Q.zero_impression_pages(crawl(spark, sf), rows(spark, sf))


@query("zero_impression_pages_canonical", _zero(sql_canonical("page"), sql_canonical("p.url")))
def zero_impressions_canonical(spark, sf):
    return Q.zero_impression_pages(crawl(spark, sf), rows(spark, sf), canonical=True)


# Redirect chains of the crawl, followed step by step until they end or come back.
CLOSURE = f"""
  WITH RECURSIVE edges AS (
    SELECT project_id, source, max_by(target, ordered) AS target FROM (
      SELECT project_id, {sql_canonical('url')} AS source, {sql_canonical('redirected_to')} AS target, url AS ordered FROM {{crawl_flat}} c WHERE redirected_to IS NOT NULL) e
    WHERE source <> target GROUP BY 1, 2),
  walk AS (
    SELECT project_id, source, target AS node, [source] AS seen FROM edges
    UNION ALL
    SELECT w.project_id, w.source, e.target, list_append(w.seen, w.node) FROM walk w
      JOIN edges e ON e.project_id = w.project_id AND e.source = w.node WHERE NOT list_contains(w.seen, w.node))
  SELECT w.project_id, w.source, w.node AS final FROM walk w
  LEFT JOIN edges e ON e.project_id = w.project_id AND e.source = w.node
  WHERE e.source IS NULL OR list_contains(w.seen, w.node)"""


def closure(spark, sf):
    return L.redirect_closure(L.redirect_edges(load(spark, sf, "crawl_flat")))


def _cannibal(final: str, joined: str) -> str:
    return f"""
    r AS (SELECT c.project_id, query, {final} AS final_page, position, page, impressions FROM {CURRENT} c {joined} WHERE page IS NOT NULL),
    per_page AS (SELECT project_id, query, final_page, min(position) AS position, arg_min(page, (position, page)) AS page, sum(impressions) AS impressions FROM r GROUP BY 1, 2, 3)"""


_JOINED = f"LEFT JOIN closure k ON k.project_id = c.project_id AND k.source = {sql_canonical('page')}"
_FINDING = """
    SELECT project_id, query, CASE WHEN top20 >= 2 THEN 'critical' ELSE 'high' END AS severity, 'cannibalization' AS category,
           chr(39) || query || chr(39) || ': ' || pages || ' pages compete (' || impressions || ' impressions together)' AS title,
           best_page AS page_url, page_list AS current_text,
           'Consolidate on ' || best_page || ' (position ' || round_even(best_position, 1) || ')' AS suggested_text,
           '1d' AS effort, CASE WHEN top20 >= 2 THEN 4 ELSE 3 END AS impact
    FROM (SELECT project_id, query, count(*) AS pages, sum(impressions) AS impressions, count(*) FILTER (WHERE position <= 20) AS top20,
                 arg_min(page, (position, page)) AS best_page, min(position) AS best_position,
                 array_to_string(list_slice(list_sort(list(final_page)), 1, 20), ', ') AS page_list
          FROM per_page GROUP BY 1, 2 HAVING count(*) >= 2) g"""


@query("cannibalization", f"WITH closure AS ({CLOSURE}), {_cannibal('coalesce(k.final, ' + sql_canonical('page') + ')', _JOINED)} {_FINDING}")
def cannibalization(spark, sf):
    return Q.cannibalization(rows(spark, sf), closure(spark, sf))


@query("cannibalization_without_redirects", f"WITH {_cannibal(sql_canonical('page'), '')} {_FINDING}")
def cannibalization_plain(spark, sf):
    return Q.cannibalization(rows(spark, sf))


@query("cannibal_pages", f"""WITH closure AS ({CLOSURE}), {_cannibal('coalesce(k.final, ' + sql_canonical('page') + ')', _JOINED)}
    SELECT p.*, n.pages FROM per_page p JOIN (SELECT project_id, query, count(*) AS pages FROM per_page GROUP BY 1, 2 HAVING count(*) >= 2) n
      ON n.project_id = p.project_id AND n.query = p.query""")
def cannibal_pages(spark, sf):
    return Q.cannibal_pages(rows(spark, sf), closure(spark, sf))


DECAY = """
    WITH h AS (SELECT project_id, clicks, row_number() OVER (PARTITION BY project_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY project_id) AS days FROM {daily_rows} d),
    a AS (SELECT project_id, max(days) AS days, avg(clicks) FILTER (WHERE rn <= floor(days / 2)) AS older_avg,
                 avg(clicks) FILTER (WHERE rn > floor(days / 2)) AS recent_avg FROM h GROUP BY 1),
    m AS (SELECT *, CASE WHEN days < 60 THEN 'fewer than 60 days loaded' WHEN older_avg = 0 THEN 'no clicks in the older half' END AS reason FROM a),
    decay AS (SELECT *, CASE WHEN reason IS NULL THEN (older_avg - recent_avg) / older_avg END AS drop_share FROM m)"""


@query("content_decay", DECAY + " SELECT *, coalesce(drop_share > 0.30, FALSE) AS decayed FROM decay")
def decay(spark, sf):
    return Q.content_decay(load(spark, sf, "daily_rows"))


@query("never_clicked_issue", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY impressions DESC, query, page NULLS FIRST) AS rn FROM {CURRENT} c
               WHERE position <= 10 AND impressions >= 30 AND clicks = 0),
    t AS (SELECT project_id, sum(clicks) >= 30 AS reliable FROM {CURRENT} c GROUP BY 1)
    SELECT n.project_id, 'medium' AS severity, 'ctr' AS category, count(*) || ' first-page keywords with many impressions and no clicks' AS title,
           NULL AS page_url,
           string_agg(chr(39) || query || chr(39) || ' (position ' || round_even(position, 1) || ', ' || impressions || ' impressions)', ', ' ORDER BY rn) FILTER (WHERE rn <= 5) AS current_text,
           'Check title, description and intent of the ranking page' || CASE WHEN bool_or(reliable) THEN '' ELSE '; too few clicks on the site to be conclusive' END AS suggested_text,
           '1h' AS effort, 3 AS impact
    FROM n JOIN t ON t.project_id = n.project_id GROUP BY 1""")
def never_clicked_issue(spark, sf):
    return Q.never_clicked_issues(rows(spark, sf))


# --- scores ------------------------------------------------------------------------------------------

_PAIR = """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY date DESC) AS rn FROM {score_rows} s),
    pair AS (SELECT project_id, kind, CAST(max(date) AS STRING) AS date, max(value) FILTER (WHERE rn = 1) AS current,
                    max(value) FILTER (WHERE rn = 2) AS previous FROM r WHERE rn <= 2 GROUP BY 1, 2)"""


def scores(spark, sf):
    return load(spark, sf, "score_rows")


def _dated(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("latest_by_key", "SELECT project_id, kind, CAST(max(date) AS STRING) AS date, arg_max(value, date) AS value FROM {score_rows} s GROUP BY 1, 2")
def latest_by_key(spark, sf):
    return _dated(S.latest_by_kind(scores(spark, sf)), "date")


@query("latest_answers", "SELECT project_id, provider, prompt, arg_max(prompt_type, checked_at) AS prompt_type, max(checked_at) AS checked_at, md5(arg_max(response_text, checked_at)) AS answer FROM {answer_rows} a GROUP BY 1, 2, 3")
def latest_answers(spark, sf):
    found = S.latest_by_key(load(spark, sf, "answer_rows"), ["project_id", "provider", "prompt"], "checked_at")
    return found.select("project_id", "provider", "prompt", "prompt_type", "checked_at", F.md5("response_text").alias("answer"))


@query("score_delta", _PAIR + " SELECT *, current - previous AS delta FROM pair")
def score_delta(spark, sf):
    return _dated(S.score_delta(scores(spark, sf)), "date")


@query("score_drops", _PAIR + " SELECT project_id, kind, previous, current, previous - current AS drop_points FROM pair WHERE previous - current >= 10 AND kind <> 'content'")
def score_drops(spark, sf):
    return S.score_drops(scores(spark, sf))


@query("scores_history", """
    SELECT project_id, kind, CAST(date AS STRING) AS date, value, count(*) OVER (PARTITION BY project_id) AS points,
           CASE WHEN count(*) OVER (PARTITION BY project_id) < 2 THEN 'fewer than two measurements' END AS empty_reason
    FROM {score_rows} s WHERE kind IN ('seo', 'geo', 'technical')""")
def scores_history(spark, sf):
    return _dated(S.scores_history(scores(spark, sf)), "date")


DAYS = """(SELECT project_id, min(date) AS from_date, max(date) AS to_date FROM (
      SELECT project_id, date, row_number() OVER (PARTITION BY project_id ORDER BY date DESC) AS rn
      FROM (SELECT DISTINCT project_id, date FROM {score_rows} s WHERE kind = 'seo') d) r WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2)"""


@query("audit_compare_scores", f"""
    SELECT s.project_id, kind, max(value) FILTER (WHERE date = from_date) AS from_value, max(value) FILTER (WHERE date = to_date) AS to_value,
           max(value) FILTER (WHERE date = to_date) - max(value) FILTER (WHERE date = from_date) AS delta
    FROM {{score_rows}} s JOIN {DAYS} d ON d.project_id = s.project_id WHERE date IN (from_date, to_date) GROUP BY 1, 2""")
def compare_scores(spark, sf):
    return S.compare_scores(scores(spark, sf), S.audit_days(scores(spark, sf)))


@query("audit_compare_changes", f"""
    SELECT e.project_id, event_id, CAST(ts AS STRING) AS at FROM (SELECT event_id, user_id % 5 AS project_id, ts FROM {{events}}) e
    JOIN {DAYS} d ON d.project_id = e.project_id AND ts >= from_date AND ts < to_date + INTERVAL 1 DAY""")
def compare_changes(spark, sf):
    found = load(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("project_id"), "ts")
    changed = S.changed_between(found, S.audit_days(scores(spark, sf)), "ts")
    return changed.select("project_id", "event_id", F.col("ts").cast("string").alias("at"))


@query("seo_score", """
    SELECT *, CAST(round_even(total::DOUBLE / nullif(components, 0), 0) AS INT) AS seo_score FROM (
      SELECT project_id, technical_score, content_score, geo_score, local_score,
             coalesce(technical_score, 0) + coalesce(content_score, 0) + coalesce(geo_score, 0) + coalesce(local_score, 0) AS total,
             CAST(technical_score IS NOT NULL AS INT) + CAST(content_score IS NOT NULL AS INT) + CAST(geo_score IS NOT NULL AS INT) + CAST(local_score IS NOT NULL AS INT) AS components
      FROM (SELECT project_id, date, max(value) FILTER (WHERE kind = 'technical') AS technical_score, max(value) FILTER (WHERE kind = 'content' AND value > 50) AS content_score,
                   max(value) FILTER (WHERE kind = 'geo' AND value < 60) AS geo_score, max(value) FILTER (WHERE kind = 'local' AND value < 40) AS local_score
            FROM {score_rows} s GROUP BY 1, 2) w) t""")
def seo_score(spark, sf):
    def pick(kind, when):
        return F.max(F.when((F.col("kind") == kind) & when, F.col("value"))).alias(f"{kind}_score")

    v = F.col("value")
    wide = scores(spark, sf).groupBy("project_id", "date").agg(
        pick("technical", v >= 0), pick("content", v > 50), pick("geo", v < 60), pick("local", v < 40)
    )
    out = S.seo_score(wide).drop("date")
    total = sum((F.coalesce(f"{k}_score", F.lit(0)) for k in ("content", "geo", "local")), F.coalesce("technical_score", F.lit(0)))
    return out.withColumn("total", total)


# --- questions against queries -----------------------------------------------------------------------


@query("already_has_real_data", """
    SELECT q.project_id, question, EXISTS (SELECT 1 FROM (SELECT DISTINCT project_id, strip_accents(lower(query)) AS own FROM {search_rows} s) o
      WHERE o.project_id = q.project_id AND (contains(strip_accents(lower(question)), own) OR contains(own, strip_accents(lower(question))))) AS has_real_data
    FROM {question_rows} q""")
def real_data(spark, sf):
    return R.already_has_real_data(load(spark, sf, "question_rows"), load(spark, sf, "search_rows"))
