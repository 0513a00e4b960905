"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Shared pieces are composed as CTE text.  Patterns are RE2-compatible.
"""

from __future__ import annotations

from ferret.functions.text import STOP_WORDS
from ferret.operators.catalog import DEFAULT_MIMETYPE, DEFAULT_TESTQUERY

WORD = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*".replace("'", "''")
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
UP_SINCE = "TIMESTAMP '2024-01-01 00:00:00'"

HITS = """
h AS (
  SELECT doc_id, source || '@doc/' || CAST(doc_id AS VARCHAR) AS hit_id, source AS rid,
         'doc/' || CAST(doc_id AS VARCHAR) AS url, split_part(text, chr(10), 1) AS title,
         text AS description, lang AS type
  FROM documents)"""

POSTINGS = f"""
p_all AS (
  SELECT 'terms' AS field, hit_id,
         unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description, url, rid, type)), '{WORD}'))) AS term
  FROM h WHERE title IS NOT NULL
  UNION ALL
  SELECT 'title' AS field, hit_id, unnest(list_distinct(regexp_extract_all(lower(title), '{WORD}'))) AS term
  FROM h WHERE title IS NOT NULL),
p AS (SELECT field, hit_id, term FROM p_all WHERE NOT list_contains({STOP_LIST}, term)),
n AS (SELECT count(*) AS n FROM h WHERE title IS NOT NULL)"""

QUERY_TERMS = f"""
q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (
  SELECT qid, term, count(*) AS cnt
  FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{WORD}')) AS term
        FROM q WHERE regexp_matches(query, '[^\\x00-\\x20]'))
  WHERE NOT list_contains({STOP_LIST}, term)
  GROUP BY qid, term)"""

SCORED = """
pq AS (SELECT * FROM p WHERE term IN (SELECT term FROM qt)),
dfs AS (SELECT field, term, count(*) AS df FROM pq GROUP BY field, term),
w AS (
  SELECT qt.qid, dfs.field, dfs.term,
         qt.cnt * (CASE dfs.field WHEN 'terms' THEN 1.0 WHEN 'title' THEN 0.02 ELSE 0.0 END)
           * ln(1.0 + ((SELECT n FROM n) - dfs.df + 0.5) / (dfs.df + 0.5)) AS w
  FROM qt JOIN dfs ON qt.term = dfs.term),
scored AS (
  SELECT w.qid, pq.hit_id, sum(w.w) AS score
  FROM pq JOIN w ON pq.field = w.field AND pq.term = w.term
  GROUP BY w.qid, pq.hit_id),
ranked AS (
  SELECT qid, hit_id, score,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, hit_id ASC) AS INTEGER) AS rank
  FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 80),
res AS (
  SELECT top.qid, top.rank, top.hit_id, top.score, h.rid, h.type, h.title, h.url
  FROM top JOIN h ON top.hit_id = h.hit_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


SEARCH = with_(HITS, POSTINGS, QUERY_TERMS, SCORED) + """
SELECT qid, rank, hit_id, round(score, 6) AS score, rid, type, title, url FROM res"""

TERM_STATS = with_(HITS, POSTINGS) + """
SELECT field, term, count(*) AS df, (SELECT n FROM n) AS n,
       round(ln(1.0 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
FROM p GROUP BY field, term"""

RESOURCES = f"""
docs AS (SELECT doc_id, source, lang, split_part(text, chr(10), 1) AS title FROM documents),
rsrc AS (
  SELECT d.source AS id, arg_min(d.title, d.doc_id) AS name,
         array_to_string(list_sort(list_distinct(list(d.lang))), ' ') AS type,
         avg(l.quality) * 0.1 AS prior,
         coalesce(avg(l.toxic) > 0.25, false) AS deleted,
         CAST(count(*) FILTER (WHERE l.quality = 1) AS INTEGER) AS requestsok,
         CAST(count(*) FILTER (WHERE l.quality = 0) AS INTEGER) AS requestserr,
         {UP_SINCE} AS upsince
  FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
cat AS (
  SELECT *, round(coalesce(prior, 0.0)
               + requestsok / floor(greatest(date_diff('millisecond', upsince, {NOW}), 604800000) / 6000)
               - requestserr / floor(greatest(date_diff('millisecond', upsince, {NOW}), 604800000) / 6000), 9) AS eff_prior
  FROM rsrc)"""


def type_match(text: str, wanted: str) -> str:
    return f"({wanted} IS NULL OR {wanted} = '' OR ({text} IS NOT NULL AND contains({text}, {wanted})))"


def f1_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^a-z0-9]+'), lambda x: x <> '')"


T2 = "rscore DESC, rid DESC NULLS LAST, score DESC, pos ASC NULLS LAST, hit_id ASC NULLS LAST"


def top_resources_sql(k: int) -> str:
    """T1 by brute force over every (query, live resource) pair."""
    return f"""
qtok AS (SELECT qid, unnest({f1_tokens('query')}) AS tok FROM qq WHERE query IS NOT NULL),
rtok AS (SELECT id, unnest(list_distinct(list_concat({f1_tokens('name')}, [lower(id)]))) AS tok
         FROM cat WHERE NOT deleted AND name IS NOT NULL),
ns AS (SELECT qid, id, CAST(count(*) AS DOUBLE) AS name_score FROM qtok JOIN rtok USING (tok) GROUP BY qid, id),
t1 AS (
  SELECT qid, id AS rid, score AS top FROM (
    SELECT qq.qid, c.id, coalesce(ns.name_score, 0.0) + c.eff_prior AS score,
           row_number() OVER (PARTITION BY qq.qid ORDER BY coalesce(ns.name_score, 0.0) + c.eff_prior DESC, c.id DESC) AS r
    FROM qq JOIN cat c ON NOT c.deleted AND {type_match('c.type', 'qq.qtype')}
    LEFT JOIN ns ON ns.qid = qq.qid AND ns.id = c.id)
  WHERE r <= {k})"""


def selection_sql(max_: int, start: int, results: str = "res_search") -> str:
    """R7 over ``results(qid, rank, hit_id, rid, type, score)`` and ``qq(qid, query, qtype)``."""
    page = f"run <= {max_}" if start <= 0 else f"run BETWEEN {start + 1} AND {start + max_}"
    return top_resources_sql(max_ + start) + f""",
hq AS (
  SELECT r.qid, r.rank AS pos, r.hit_id, r.rid, round(r.score, 9) AS raw, coalesce(c.eff_prior, 0.0) AS p
  FROM {results} r JOIN qq ON r.qid = qq.qid
  LEFT JOIN cat c ON r.rid = c.id
  WHERE {type_match('r.type', 'qq.qtype')} AND NOT coalesce(c.deleted, false)),
hr AS (SELECT hq.*, row_number() OVER (PARTITION BY qid, rid ORDER BY pos) AS rn FROM hq),
hs AS (
  SELECT hr.*, t1.top,
         CASE WHEN hr.rid IS NULL THEN raw
              ELSE (CASE WHEN rn = 1 AND t1.top IS NOT NULL AND t1.top > p THEN t1.top ELSE p END) + 0.05 * raw END AS score
  FROM hr LEFT JOIN t1 ON hr.qid = t1.qid AND hr.rid = t1.rid),
hw AS (
  SELECT *,
         CASE WHEN rid IS NULL THEN 0.05 * raw
              ELSE max(score) OVER (PARTITION BY qid, rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS rscore,
         max(score) OVER (PARTITION BY qid, rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM hs),
kept AS (
  SELECT qid, pos, hit_id, rid, score, rscore FROM hw
  WHERE rid IS NULL OR rn <= 4 OR prev_max IS NULL OR score > prev_max
  UNION ALL
  SELECT qid, NULL AS pos, NULL AS hit_id, rid, top AS score, top AS rscore FROM t1
  WHERE NOT EXISTS (SELECT 1 FROM hq WHERE hq.qid = t1.qid AND hq.rid = t1.rid)),
runs AS (
  SELECT *, CASE WHEN rid IS NOT NULL AND (prev_rid IS NULL OR rid <> prev_rid) THEN 1 ELSE 0 END AS new_run
  FROM (SELECT *, last_value(rid IGNORE NULLS) OVER (PARTITION BY qid ORDER BY {T2}
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_rid FROM kept)),
runs2 AS (SELECT *, sum(new_run) OVER (PARTITION BY qid ORDER BY {T2} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
          FROM runs),
page AS (SELECT * FROM runs2 WHERE {page})
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {T2}) AS INTEGER) AS rank, rid, hit_id,
       round(score, 6) AS score, round(rscore, 6) AS rscore, CAST(run AS BIGINT) AS run
FROM page"""


def select_resources_sql(max_: int, start: int, qtype: str | None) -> str:
    qt = "CAST(NULL AS VARCHAR)" if qtype is None else f"'{qtype}'"
    qq = f"qq AS (SELECT qid, query, {qt} AS qtype FROM q)"
    res_search = "res_search AS (SELECT * FROM res)"
    return with_(HITS, POSTINGS, QUERY_TERMS, SCORED, RESOURCES, qq, res_search) + "," + selection_sql(max_, start)


def list_resources_sql(max_: int, start: int) -> str:
    qq = "qq AS (SELECT lang AS qid, CAST(NULL AS VARCHAR) AS query, lang AS qtype FROM (SELECT DISTINCT lang FROM documents))"
    res_search = ("res_search AS (SELECT CAST(NULL AS VARCHAR) AS qid, 0 AS rank, CAST(NULL AS VARCHAR) AS hit_id, "
                  "CAST(NULL AS VARCHAR) AS rid, CAST(NULL AS VARCHAR) AS type, 0.0 AS score WHERE false)")
    return with_(RESOURCES, qq, res_search) + "," + selection_sql(max_, start)

CONV = f"""
conv AS (
  SELECT conv_id AS qid, turn AS pos, 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS hit_id,
         role AS title,
         concat_ws(' ', role, text, 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)) AS txt
  FROM conversations WHERE turn > 0),
qs AS (SELECT conv_id AS qid, list_distinct({f1_tokens('text')}) AS qterms FROM conversations WHERE turn = 0),
sc AS (
  SELECT c.qid, c.pos, c.hit_id,
         CAST(0.1 AS DOUBLE) * len(list_distinct(list_intersect({f1_tokens('c.txt')}, coalesce(q.qterms, []::VARCHAR[]))))
         + CAST(0.01 AS DOUBLE) * len(list_distinct(list_intersect({f1_tokens('c.title')}, coalesce(q.qterms, []::VARCHAR[])))) AS score,
         len(list_distinct(list_intersect({f1_tokens('c.txt')}, coalesce(q.qterms, []::VARCHAR[])))) > 0 AS hit
  FROM conv c LEFT JOIN qs q ON c.qid = q.qid)"""

RERANK_GENERAL = with_(CONV) + """
SELECT qid, pos, hit_id, round(score, 6) AS score FROM sc WHERE score > 0.001"""

RERANK_ANYRESULT = with_(CONV) + """
SELECT qid, pos, hit_id FROM sc WHERE qid IN (SELECT qid FROM sc WHERE hit)"""

RERANK_RANDOM = with_(CONV) + """
SELECT qid, pos, hit_id, md5('42|' || CAST(qid AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS shuffle_key FROM conv"""

RERANK_BESTRANDOM = with_(CONV) + """,
k AS (SELECT *, md5('42|' || CAST(qid AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS shuffle_key FROM sc),
b AS (SELECT *, score + CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY shuffle_key, pos) <= 10 THEN CAST(0.01 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS s FROM k)
SELECT qid, pos, hit_id, round(s, 6) AS score, shuffle_key FROM b WHERE s > 0.001"""

SAMPLE_RESOURCE = with_(RESOURCES) + """
SELECT arg_min(id, md5('42|' || id)) AS id FROM cat WHERE NOT deleted"""

NEXT_PROBE = with_(HITS) + f""",
pick AS (SELECT rid, arg_min(title || ' ' || description, md5('42|' || hit_id)) AS t FROM h GROUP BY rid),
k AS (SELECT rid, list_filter({f1_tokens('t')}, lambda x: x <> 'the') AS ws FROM pick)
SELECT rid, ws[CAST('0x' || substr(md5('42|' || rid), 1, 8) AS BIGINT) % greatest(len(ws), 1) + 1] AS query FROM k"""

LOG = """
log AS (
  SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS rid, ts, event_type = 'error' AS error,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS hits,
         CASE WHEN event_type = 'error' THEN props END AS message, event_type AS query
  FROM events)"""

HEALTH = LOG + """,
health AS (
  SELECT rid,
         CAST(count(*) FILTER (WHERE NOT error AND hits >= 1) AS INTEGER) AS requestsok,
         CAST(count(*) FILTER (WHERE error) AS INTEGER) AS requestserr,
         max(ts) FILTER (WHERE NOT error AND hits >= 1) AS lastsuccess,
         max(ts) FILTER (WHERE error) AS lasterror,
         arg_max(message, ts) FILTER (WHERE error) AS lastmessage,
         max(ts) AS lastused
  FROM log GROUP BY rid)"""

RESOURCE_HEALTH = with_(HEALTH) + """
SELECT * FROM health"""

HEALTH_SUMMARY = with_(HEALTH) + """,
hh AS (SELECT *, (coalesce(lastsuccess, TIMESTAMP '1970-01-01') >= coalesce(lasterror, TIMESTAMP '1970-01-01'))
                 OR coalesce(requestserr, 0) = 0 AS ok FROM health)
SELECT count(*) FILTER (WHERE ok) AS enginesok, count(*) FILTER (WHERE NOT ok) AS engineserr,
       coalesce(arg_max(rid || ': ' || coalesce(lastmessage, 'null'), rid) FILTER (WHERE NOT ok),
                arg_min(rid || ': ' || coalesce(lastmessage, 'null'), rid) FILTER (WHERE lastmessage IS NOT NULL)) AS lastmessage
FROM hh"""

HEALTH_SUMMARY_MOTHER = with_(HEALTH) + """,
hh AS (SELECT *, (coalesce(lastsuccess, TIMESTAMP '1970-01-01') >= coalesce(lasterror, TIMESTAMP '1970-01-01'))
                 OR coalesce(requestserr, 0) = 0 AS ok FROM health),
m AS (SELECT count(*) AS errors, arg_max(message, (ts, event_id)) AS msg FROM log WHERE error)
SELECT (SELECT count(*) FILTER (WHERE ok) FROM hh) + CASE WHEN errors = 0 THEN 1 ELSE 0 END AS enginesok,
       (SELECT count(*) FILTER (WHERE NOT ok) FROM hh) + CASE WHEN errors > 0 THEN 1 ELSE 0 END AS engineserr,
       'm (mother): ' || msg AS lastmessage
FROM m"""

QUERY_COUNTERS = with_(LOG) + """
SELECT count(*) FILTER (WHERE NOT error) AS requestsok, count(*) FILTER (WHERE error) AS requestserr, min(ts) AS upsince
FROM log"""

UPTIME_REPORT = with_(LOG) + """,
l2 AS (SELECT rid, ts, error AND CAST(substr(rid, 2) AS BIGINT) % 3 <> 0 AS error,
              CASE WHEN CAST(substr(rid, 2) AS BIGINT) % 3 = 0 THEN 1 ELSE hits END AS hits FROM log),
h AS (SELECT rid, count(*) FILTER (WHERE NOT error AND hits >= 1) AS ok, count(*) FILTER (WHERE error) AS err,
             max(ts) FILTER (WHERE NOT error AND hits >= 1) AS ls, max(ts) FILTER (WHERE error) AS le FROM l2 GROUP BY rid),
r AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS rid FROM customer)
SELECT r.rid,
       CASE WHEN h.ok IS NULL THEN 'No health'
            WHEN h.ls IS NOT NULL AND (h.le IS NULL OR date_trunc('second', h.ls) > date_trunc('second', h.le)) THEN 'Ok'
            ELSE 'Error' END AS conclusion,
       round(100.0 * h.ok / (h.ok + h.err + 0.01), 6) AS uptime
FROM r LEFT JOIN h ON r.rid = h.rid"""

SECONDS_SINCE_USE = with_(HEALTH) + f"""
SELECT rid, CASE WHEN ago < 0 OR ago > 8640000 OR ago IS NULL THEN 8640000 ELSE ago END AS seconds_ago
FROM (SELECT rid, 1 + CAST(trunc(date_diff('millisecond', lastused, {NOW}) / 1000) AS BIGINT) AS ago FROM health)"""

MAX_PRIOR = with_(RESOURCES.lstrip()) + """
SELECT round(greatest(max(eff_prior), 0.0), 6) AS max_prior FROM cat"""

API = "https://api.example.org/search/"

CATALOG = f"""
sn AS (SELECT s.*, lower(n.n_name) AS ntype FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
old AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, ntype AS type, s_acctbal / 10000.0 AS prior,
         '{API}s' || CAST(s_suppkey AS VARCHAR) || '?q={{searchTerms}}&page={{startPage?}}&key={{apikey}}' AS apitemplate,
         md5(s_name) AS apikey, false AS deleted,
         CAST(s_nationkey AS INTEGER) AS requestsok, 0 AS requestserr,
         {UP_SINCE} AS lastupdated, {UP_SINCE} AS upsince, CAST(NULL AS VARCHAR) AS lastmessage,
         {UP_SINCE} + to_hours(CAST(s_nationkey AS INTEGER)) AS lastsuccess,
         CASE WHEN s_nationkey % 2 = 0 THEN {UP_SINCE} END AS lasterror
  FROM sn),
upd AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id,
         CASE WHEN s_acctbal >= 0 THEN s_name END AS name,
         CASE WHEN s_acctbal >= 0 THEN ntype END AS type,
         CASE WHEN s_acctbal >= 0 THEN round(s_acctbal / 10000.0, 2) END AS prior,
         CASE WHEN s_acctbal >= 0 THEN '{API}s' || CAST(s_suppkey AS VARCHAR) || '?q={{searchTerms}}&page={{startPage?}}&key={{apikey}}' END AS apitemplate,
         CASE WHEN s_acctbal >= 0 THEN md5(s_name || '/2') END AS apikey,
         s_acctbal < 0 AS deleted
  FROM sn
  UNION ALL
  SELECT 'c' || CAST(c_custkey AS VARCHAR), c_name, lower(c_mktsegment), c_acctbal / 10000.0,
         '{API}c' || CAST(c_custkey AS VARCHAR) || '?q={{searchTerms}}', NULL, false
  FROM customer)"""

MERGE_RESOURCES = with_(CATALOG) + f""",
j AS (
  SELECT o.id AS o_id, u.id AS n_id, o.name AS o_name, u.name AS n_name, o.type AS o_type, u.type AS n_type,
         o.prior AS o_prior, u.prior AS n_prior, o.apitemplate AS o_api, u.apitemplate AS n_api,
         o.apikey AS o_key, u.apikey AS n_key, o.deleted AS o_del, u.deleted AS n_del,
         o.requestsok, o.requestserr, o.lastupdated, o.upsince, o.lastmessage, o.lastsuccess, o.lasterror
  FROM old o FULL OUTER JOIN upd u ON o.id = u.id),
k AS (
  SELECT *, n_id IS NOT NULL AND (o_id IS NULL OR
              o_name IS DISTINCT FROM n_name OR o_type IS DISTINCT FROM n_type OR o_api IS DISTINCT FROM n_api
              OR o_del IS DISTINCT FROM n_del OR abs(coalesce(o_prior, 0.0) - coalesce(n_prior, 0.0)) > 0.001) AS take_new
  FROM j)
SELECT CASE WHEN take_new THEN n_id ELSE o_id END AS id,
       CASE WHEN take_new THEN n_name ELSE o_name END AS name,
       CASE WHEN take_new THEN n_type ELSE o_type END AS type,
       round(CASE WHEN take_new THEN n_prior ELSE o_prior END, 6) AS prior,
       CASE WHEN take_new THEN n_del ELSE o_del END AS deleted,
       CASE WHEN take_new THEN n_api ELSE o_api END AS apitemplate,
       CASE WHEN take_new THEN n_key ELSE o_key END AS apikey,
       CASE WHEN take_new THEN 0 ELSE requestsok END AS requestsok,
       CASE WHEN take_new THEN 0 ELSE requestserr END AS requestserr,
       CASE WHEN n_id IS NULL THEN lastupdated ELSE {NOW} END AS lastupdated,
       CASE WHEN take_new THEN {NOW} ELSE upsince END AS upsince,
       CASE WHEN take_new THEN NULL ELSE lastmessage END AS lastmessage, lastsuccess, lasterror
FROM k"""


def rate_limit_sql(src: str, rate: float | str) -> str:
    """ST2 by a recursive walk over each resource's requests in time order.

    ``src`` yields (req_id, rid, ts); ``rate`` is a number or an expression over rid."""
    return f"""
rq AS (SELECT req_id, rid, ts, epoch_us(ts) // 1000 AS ms, CAST({rate} AS DOUBLE) AS rate,
              row_number() OVER (PARTITION BY rid ORDER BY ts, req_id) AS n FROM ({src})),
walk AS (
  SELECT rid, n, req_id, ts, ms, b > 1 AS accepted, CASE WHEN b > 1 THEN b - 1 ELSE b END AS allowance
  FROM (SELECT *, least(rate, CAST(500 AS DOUBLE)) AS b FROM rq WHERE n = 1)
  UNION ALL
  SELECT rid, n, req_id, ts, ms, b > 1, CASE WHEN b > 1 THEN b - 1 ELSE b END
  FROM (SELECT r.rid, r.n, r.req_id, r.ts, r.ms,
               least(r.rate, w.allowance + (CAST(r.ms - w.ms AS DOUBLE) / CAST(86400000 AS DOUBLE)) * r.rate) AS b
        FROM walk w JOIN rq r ON r.rid = w.rid AND r.n = w.n + 1))"""


RATE_LIMIT_PER_RESOURCE = "WITH RECURSIVE " + rate_limit_sql(
    "SELECT event_id AS req_id, 'u' || CAST(user_id AS VARCHAR) AS rid, ts FROM events",
    "CASE WHEN CAST(substr(rid, 2) AS BIGINT) % 5 = 0 THEN 400 WHEN CAST(substr(rid, 2) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END"
) + """
SELECT req_id, rid, ts, floor(allowance * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS allowance, accepted FROM walk"""

RATE_LIMIT = "WITH RECURSIVE " + rate_limit_sql(
    "SELECT event_id AS req_id, 'u' || CAST(user_id AS VARCHAR) AS rid, ts FROM events", 2.0
) + """
SELECT req_id, rid, ts, floor(allowance * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS allowance, accepted FROM walk"""

ENC = "replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def fill_sql(t: str, q: str, page: str, key: str) -> str:
    x = f"replace(replace({t}, '{{apikey}}', coalesce({key}, '{{apikey}}')), '{{apikey?}}', coalesce({key}, '{{apikey?}}'))"
    x = f"replace(replace({x}, '{{searchTerms}}', {q}), '{{searchTerms?}}', {q})"
    x = f"replace(replace({x}, '{{q}}', {q}), '{{q?}}', {q})"
    x = (f"CASE WHEN {page} IS NULL THEN replace({x}, '{{startPage}}', '1') "
         f"ELSE replace(replace({x}, '{{startPage}}', CAST({page} AS VARCHAR)), '{{startPage?}}', CAST({page} AS VARCHAR)) END")
    return f"regexp_replace({x}, '\\{{[0-9A-Za-z\\-_]+\\?\\}}', '', 'g')"


PLAN_REQUESTS = "WITH RECURSIVE " + rate_limit_sql(
    "SELECT event_id AS req_id, 's' || CAST(user_id AS VARCHAR) AS rid, ts FROM events WHERE event_id % 10 <> 0", 2.0
) + f""",
{CATALOG.strip()},
cat AS (
  SELECT *, CASE WHEN s_acctbal > 5000 THEN 'q={{searchTerms}}&key={{apikey}}&page={{startPage?}}' END AS post,
         CASE WHEN s_acctbal > 8000 THEN 'application/json' END AS postencode,
         s_acctbal >= 0 AND s_acctbal <= 1000 AS direct
  FROM old JOIN sn ON old.id = 's' || CAST(sn.s_suppkey AS VARCHAR)),
req AS (
  SELECT e.event_id AS req_id, 's' || CAST(e.user_id AS VARCHAR) AS rid, e.event_type AS query,
         CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS page, w.accepted
  FROM events e LEFT JOIN walk w ON w.req_id = e.event_id),
f AS (
  SELECT req.*, cat.id IS NOT NULL AS known, cat.deleted, coalesce(cat.direct, false) AS direct, req.req_id % 10 = 0 AS in_cache, cat.post, cat.apitemplate, cat.apikey,
         {fill_sql('cat.apitemplate', ENC.format(x='req.query'), 'CAST(NULL AS INTEGER)', 'cat.apikey')} AS to0,
         {fill_sql('cat.apitemplate', ENC.format(x='req.query'), 'req.page', 'cat.apikey')} AS url0,
         {fill_sql('cat.post', "CASE WHEN cat.postencode IS NULL THEN " + ENC.format(x='req.query') + " WHEN cat.postencode = 'application/json' THEN replace(req.query, '\"', '\\\\\"') ELSE req.query END", 'req.page', 'cat.apikey')} AS body0
  FROM req LEFT JOIN cat ON req.rid = cat.id),
g AS (
  SELECT *, regexp_matches(url0, '\\{{[0-9A-Za-z\\-_]+\\}}') AS url_bad, coalesce(post, '') <> '' AS has_post,
         regexp_matches(body0, '\\{{[0-9A-Za-z\\-_]+\\}}') AS body_bad FROM f),
h AS (
  SELECT *, CASE WHEN NOT known THEN 'error'
                 WHEN coalesce(deleted, false) THEN 'gone'
                 WHEN direct AND NOT regexp_matches(to0, '\\{{[0-9A-Za-z\\-_]+\\}}') THEN 'redirect'
                 WHEN direct THEN 'error'
                 WHEN in_cache THEN 'cached'
                 WHEN NOT coalesce(accepted, true) THEN 'error'
                 WHEN apitemplate IS NULL THEN 'error'
                 WHEN url_bad OR (has_post AND body_bad) THEN 'error'
                 ELSE 'fetch' END AS action
  FROM g)
SELECT req_id, rid, action,
       CASE WHEN action = 'fetch' THEN CASE WHEN has_post THEN 'POST' ELSE 'GET' END END AS method,
       CASE WHEN action = 'fetch' THEN url0 WHEN action = 'redirect' THEN to0 END AS url,
       CASE WHEN action = 'fetch' AND has_post THEN body0 END AS body,
       CASE WHEN NOT known THEN 'Unknown resource'
            WHEN coalesce(deleted, false) THEN 'Gone'
            WHEN direct THEN CASE WHEN action = 'error' THEN 'Missing url parameter ' || regexp_extract(to0, '(\\{{[^}}]*\\}})', 1) END
            WHEN in_cache THEN NULL
            WHEN NOT coalesce(accepted, true) THEN 'Too many queries'
            WHEN apitemplate IS NULL THEN 'No API Template'
            WHEN url_bad THEN 'Missing url parameter ' || regexp_extract(url0, '(\\{{[^}}]*\\}})', 1)
            WHEN has_post AND body_bad THEN 'Missing url parameter ' || regexp_extract(body0, '(\\{{[^}}]*\\}})', 1)
       END AS error
FROM h"""

def local_search_sql(max_: int, start: int) -> str:
    """An index of German documents, one of web pages, and the listing for blank queries."""
    ask = QUERY_TERMS.replace("text AS query", "CASE WHEN item_id % 10 = 0 THEN ' ' ELSE text END AS query")
    title = clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    body = clean_sql("regexp_replace(html, '(?is)<title[^>]*>.*?</title>|<script.*?</script>|<style.*?</style>', ' ', 'g')")
    host = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
    web = f"""
h AS (SELECT {host} || '@' || url AS hit_id, {host} AS rid, url, {title} AS title, {body} AS description,
             CAST(NULL AS VARCHAR) AS type FROM pages)"""
    own = HITS.replace("FROM documents)", "FROM documents WHERE lang = 'de')")
    query = "SELECT item_id AS qid, CASE WHEN item_id % 10 = 0 THEN ' ' ELSE text END AS query, CAST(NULL AS VARCHAR) AS qtype FROM benchmark"
    none = ("SELECT CAST(NULL AS BIGINT) AS qid, 0 AS rank, CAST(NULL AS VARCHAR) AS hit_id, "
            "CAST(NULL AS VARCHAR) AS rid, CAST(NULL AS VARCHAR) AS type, 0.0 AS score WHERE false")
    return with_(
        RESOURCES,
        "loc AS (" + with_(own, POSTINGS, ask, SCORED) + " SELECT * FROM res)",
        "fb AS (" + with_(web, POSTINGS, ask, SCORED) + " SELECT * FROM res)",
        f"a AS (WITH qq AS ({query} WHERE item_id % 10 <> 0), res_search AS (SELECT * FROM loc UNION ALL SELECT * FROM fb "
        "WHERE qid NOT IN (SELECT qid FROM loc))," + selection_sql(max_, start) + ")",
        f"b AS (WITH qq AS (SELECT * FROM ({query}) WHERE qid % 10 = 0), res_search AS ({none})," + selection_sql(max_, start) + ")",
    ) + " SELECT * FROM a UNION ALL SELECT * FROM b"


CACHE_LOOKUP = """
WITH q AS (SELECT DISTINCT event_type AS query, 'u' || CAST(user_id AS VARCHAR) AS rid FROM events),
first AS (SELECT event_type AS query, 'u' || CAST(user_id AS VARCHAR) AS rid, arg_min(event_id, (ts, event_id)) AS page_id
          FROM events GROUP BY 1, 2)
SELECT q.query, q.rid, first.page_id FROM q LEFT JOIN first ON q.query = first.query AND q.rid = first.rid"""

SPAN = "(?i)</?span[^>]*>|</?b>|</?i>|</?em>|</?strong>"


def clean_sql(x: str) -> str:
    """F3 in DuckDB."""
    y = f"regexp_replace(regexp_replace({x}, '{SPAN}', '', 'g'), '<[^>]+>|' || chr(65533), ' ', 'g')"
    return f"regexp_replace(regexp_replace({y}, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')"


def absolute_url_sql(base: str, url: str) -> str:
    """F4 in DuckDB."""
    last0 = f"(CASE WHEN strpos(reverse({base}), '/') > 0 THEN length({base}) - strpos(reverse({base}), '/') ELSE -1 END)"
    first = f"strpos(substr({base}, 11), '/')"
    return f"""(CASE WHEN {base} IS NULL OR {url} IS NULL OR starts_with({url}, 'http://') OR starts_with({url}, 'https://') THEN {url}
      WHEN starts_with({url}, '//') THEN substr({base}, 1, strpos({base}, ':')) || {url}
      WHEN starts_with({url}, '/') THEN (CASE WHEN {first} > 0 THEN substr({base}, 1, 10 + {first} - 1) ELSE {base} END) || {url}
      ELSE (CASE WHEN {last0} > 10 THEN substr({base}, 1, {last0} + 1) ELSE {base} || '/' END) || {url} END)"""


# the pages in other ways of markup (derived here as the query derives them)
MARKED_UP = """(CASE WHEN page_id % 8 = 4 THEN replace(replace(html, '<nav><ul>', '<nav><ul><li><a href="/top">Top</a><ul>'), '</ul></nav>', '</ul></li></ul></nav>')
 WHEN page_id % 4 = 1 THEN replace(html, '</li>', '') WHEN page_id % 4 = 2 THEN regexp_replace(html, 'href="([^"]*)"', concat('href=', chr(39), '\\1', chr(39)), 'g')
 WHEN page_id % 4 = 3 THEN regexp_replace(html, 'href="([^"\\s]+)"', 'href=\\1', 'g') ELSE html END)"""
HREF = """coalesce(nullif(regexp_extract(item, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1), ''),
  nullif(regexp_extract(item, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*\\x27([^\\x27]*)\\x27', 1), ''), nullif(regexp_extract(item, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*([^\\s"\\x27>]+)', 1), ''))"""
EXTRACT_LINKS = f"""
WITH it AS (
  SELECT page_id, page_url, unnest(items) AS item, generate_subscripts(items, 1) AS pos
  FROM (SELECT page_id, url AS page_url, list_transform(string_split_regex(repeat({MARKED_UP}, 8), '(?i)<li(?:\\s[^>]*|/)?>')[2:],
               lambda x: regexp_replace(x, '(?is)</(?:li|ul|ol|menu)\\s*>.*', ''))[1:30] AS items FROM pages)),
f AS (
  SELECT page_id, pos, page_url,
         {clean_sql("regexp_extract(item, '(?is)<a(?:\\s[^>]*)?>(.*?)(?:</a\\s*>|$)', 1)")} AS t, {HREF} AS href
  FROM it),
g AS (
  SELECT page_id, CAST(pos AS INTEGER) AS pos, nullif(t, '') AS title,
         nullif({clean_sql(absolute_url_sql('page_url', 'href'))}, '') AS url,
         regexp_extract(page_url, '^[a-z]+://([^/?#:]+)', 1) AS rid
  FROM f)
SELECT * FROM g WHERE title IS NOT NULL OR url IS NOT NULL"""

INGEST = with_(HITS) + """
SELECT hit_id, rid, url, title, type FROM h"""

UPSERT_HITS = with_(HITS) + f""",
u AS (
  SELECT hit_id, rid, url, title, type, 0 AS seq, CAST(NULL AS VARCHAR) AS foundBefore FROM h
  UNION ALL
  SELECT h.hit_id, h.rid, h.url, h.title || ' [quality ' || CAST(l.quality AS VARCHAR) || ']', h.type, 1,
         strftime({NOW}, '%Y-%m-%d')
  FROM h JOIN labels l ON h.doc_id = l.doc_id)
SELECT hit_id, arg_max(rid, seq) AS rid, arg_max(url, seq) AS url, arg_max(title, seq) AS title,
       arg_max(type, seq) AS type, max(seq) AS seq, arg_max(foundBefore, seq) AS foundBefore
FROM u GROUP BY hit_id"""

VALID_RESOURCES = with_(CATALOG) + """
SELECT id, CASE WHEN s_acctbal >= 0 AND s_acctbal <= 2000 THEN 'directaccess with private parameters' ELSE '' END AS violations
FROM old JOIN sn ON old.id = 's' || CAST(sn.s_suppkey AS VARCHAR)"""

EXPORT_HEALTH = "WITH RECURSIVE " + rate_limit_sql(
    "SELECT event_id AS req_id, 's' || CAST(user_id AS VARCHAR) AS rid, ts FROM events", 2.0
) + f""",
{CATALOG.strip()},
{HEALTH.strip()},
last AS (SELECT rid, arg_max(allowance, (ts, req_id)) AS allowance, max(ts) AS ts FROM walk GROUP BY rid),
x AS (SELECT old.id AS rid, old.upsince, old.lastupdated, h.requestsok, h.requestserr, h.lastsuccess, h.lasterror, h.lastmessage,
             coalesce(last.allowance, 500.0)
             + (CAST((epoch_us({NOW}) - epoch_us(coalesce(last.ts, old.upsince))) // 1000 AS DOUBLE) / CAST(86400000 AS DOUBLE)) * CAST(2 AS DOUBLE) AS c
      FROM old LEFT JOIN health h ON h.rid = 'u' || substr(old.id, 2) LEFT JOIN last ON last.rid = old.id)
SELECT rid, coalesce(requestsok, 0) AS requestsok, coalesce(requestserr, 0) AS requestserr,
       CASE WHEN c > 2 THEN 2 ELSE CAST(trunc(c) AS INTEGER) END AS dayallowance,
       strftime(coalesce(lastsuccess, upsince), '%Y-%m-%d %H:%M:%S') AS lastsuccess,
       strftime(coalesce(lasterror, upsince), '%Y-%m-%d %H:%M:%S') AS lasterror,
       strftime(lastupdated, '%Y-%m-%d %H:%M:%S') AS lastupdated, strftime(upsince, '%Y-%m-%d %H:%M:%S') AS upsince, lastmessage
FROM x"""

EXPORTED = CATALOG + """,
ex AS (SELECT old.id, s_acctbal < 0 AS gone, old.name, old.type, old.apitemplate, old.prior,
              CASE WHEN ntype LIKE 'i%' THEN 'text/html' END AS mimetype, CASE WHEN old.prior > 0.5 THEN 500 END AS rate,
              'https://www.example.org/' || old.id || '?q={q}' AS urltemplate,
              CASE WHEN s_acctbal > 5000 THEN 'q={searchTerms}&key={apikey}&page={startPage?}' END AS post,
              CASE WHEN s_acctbal BETWEEN 0 AND 1000 THEN 'yes' WHEN s_acctbal > 1000 AND s_acctbal <= 2000 THEN 'no' END AS directaccess
       FROM old JOIN sn ON old.id = 's' || CAST(sn.s_suppkey AS VARCHAR))"""

EXPORT_CATALOG_SHARED = with_(EXPORTED) + f"""
SELECT id, CASE WHEN gone THEN true END AS deleted, CASE WHEN NOT gone THEN name END AS name, CASE WHEN NOT gone THEN type END AS type,
       CASE WHEN NOT gone THEN apitemplate END AS apitemplate, round(CASE WHEN NOT gone THEN prior END, 6) AS prior,
       CASE WHEN NOT gone THEN rate END AS maxqueriesperday, CASE WHEN NOT gone THEN urltemplate END AS urltemplate,
       CASE WHEN NOT gone THEN 'https://www.example.org/suggest' END AS suggesttemplate,
       CASE WHEN NOT gone THEN coalesce(mimetype, '{DEFAULT_MIMETYPE}') END AS mimetype,
       CASE WHEN NOT gone THEN post END AS post, CASE WHEN NOT gone THEN directaccess END AS directaccess
FROM ex"""

STRIP = "regexp_replace(regexp_replace(regexp_replace({x}, '(?i)</?span[^>]*>|</?b>|</?i>|</?em>|</?strong>', '', 'g'), '<[^>]+>|&#?[0-9a-zA-Z]{{1,9}};', '', 'g'), '[<>]', '', 'g')"

RESULT_PAGE_ROUNDTRIP = with_(HITS, POSTINGS, QUERY_TERMS, SCORED) + f"""
SELECT CAST(qid AS VARCHAR) || '/' || rid AS page_id,
       CAST(row_number() OVER (PARTITION BY qid, rid ORDER BY rank) AS INTEGER) AS pos,
       {STRIP.format(x=STRIP.format(x='title'))} AS title, {STRIP.format(x=STRIP.format(x='url'))} AS url
FROM res"""

ALL_LINKS = EXTRACT_LINKS.replace("[1:30]", "")

CATALOG_FROM_PAGES = ALL_LINKS.replace(f"repeat({MARKED_UP}, 8)", MARKED_UP).replace("SELECT * FROM g WHERE title IS NOT NULL OR url IS NOT NULL", """,
links AS (SELECT * FROM g WHERE title IS NOT NULL OR url IS NOT NULL),
firsts AS (SELECT url AS rid, arg_min(page_id, (page_id, pos)) AS page, arg_min(pos, (page_id, pos)) AS pos
           FROM links WHERE url IS NOT NULL GROUP BY url),
stop AS (SELECT min(page_id) AS stop FROM (SELECT DISTINCT page_id FROM links) p
         WHERE page_id NOT IN (SELECT page FROM firsts))
SELECT rid, page, pos FROM firsts WHERE (SELECT stop FROM stop) IS NULL OR page < (SELECT stop FROM stop)""")

RESULT_QUALITY = with_(HITS, POSTINGS, QUERY_TERMS, SCORED) + """,
an AS (SELECT rid, qid, count(*) FILTER (WHERE type IN ('fr', 'de')) AS n_hits,
              coalesce(bool_or(type = 'de' OR (type = 'fr' AND title = '')), false) AS bad FROM res GROUP BY rid, qid)
SELECT rid, CAST(qid AS VARCHAR) AS query, n_hits,
       CASE WHEN qid % 2 = 0 AND n_hits = 0 THEN 'No results for test query: ' || CAST(qid AS VARCHAR)
                 || CASE WHEN qid % 4 = 0 THEN '; Try removing rerank.' ELSE '' END
            WHEN qid % 2 = 0 AND bad THEN 'Search result must have a title or a rid.' END AS error,
       CASE WHEN n_hits < 10 THEN 'less than 10 results' WHEN n_hits > 49 THEN 'more than 49 results' END AS warning
FROM an"""

BOOLEAN_SEARCH = with_(HITS, POSTINGS, QUERY_TERMS, SCORED) + """,
req AS (
  SELECT qid, term FROM (
    SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS r
    FROM (SELECT DISTINCT qid, term FROM qt)) WHERE r = 1),
have AS (SELECT DISTINCT req.qid, p.hit_id FROM req JOIN p ON p.term = req.term),
no AS (SELECT t.qid, t.term FROM (SELECT qid, max(term) AS term FROM qt GROUP BY qid) t JOIN req ON req.qid = t.qid AND req.term <> t.term AND t.qid % 2 = 1),
bad AS (SELECT DISTINCT no.qid, p.hit_id FROM no JOIN p ON p.term = no.term),
kept AS (SELECT s.* FROM scored s JOIN have ON s.qid = have.qid AND s.hit_id = have.hit_id
         WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.qid = s.qid AND bad.hit_id = s.hit_id)),
rk AS (SELECT qid, hit_id, score,
              CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, hit_id ASC) AS INTEGER) AS rank
       FROM kept)
SELECT qid, rank, hit_id, round(score, 6) AS score FROM rk WHERE rank <= 80"""

REQUEST_PAGES = """
WITH r AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS page,
                  TRY_CAST(floor(value) AS INTEGER) AS mx FROM events),
m AS (SELECT event_id, page, least(greatest(coalesce(mx, 10), 1), 200) AS max FROM r)
SELECT event_id, max, greatest(coalesce((page - 1) * max, 0), 0) AS start FROM m"""

ALLOWANCE_NOW = "WITH RECURSIVE " + rate_limit_sql(
    "SELECT event_id AS req_id, 'u' || CAST(user_id AS VARCHAR) AS rid, ts FROM events", 2.0
) + f""",
last AS (SELECT rid, arg_max(allowance, (ts, req_id)) AS allowance, max(ts) AS ts FROM walk GROUP BY rid),
cur AS (SELECT rid, allowance + (CAST((epoch_us({NOW}) - epoch_us(ts)) // 1000 AS DOUBLE) / CAST(86400000 AS DOUBLE)) * CAST(2 AS DOUBLE) AS c
        FROM last)
SELECT rid, CASE WHEN c > 2 THEN 2 ELSE CAST(trunc(c) AS INTEGER) END AS dayallowance FROM cur"""

REFRESH_CANDIDATES = with_(CATALOG) + f""",
seen AS (SELECT DISTINCT 's' || CAST(user_id AS VARCHAR) AS rid, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id FROM events),
st AS (
  SELECT seen.*, old.lastupdated,
         1 + CAST(trunc(date_diff('millisecond', old.lastupdated, {NOW}) / 1000) AS BIGINT) AS ago
  FROM seen LEFT JOIN old ON seen.rid = old.id),
cand AS (SELECT * FROM st WHERE lastupdated IS NULL
         OR (CASE WHEN ago < 0 OR ago > 8640000 THEN 8640000 ELSE ago END) > 7200)
SELECT batch_id, rid FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY rid) AS r FROM cand) WHERE r <= 11"""

FAILED_COUNT = f"""
WITH rq AS ({RESULT_QUALITY}),
per AS (SELECT rid, bool_or(error IS NOT NULL) AS failed FROM rq GROUP BY rid)
SELECT count(*) FILTER (WHERE failed) AS failed, count(*) AS tested FROM per"""

EXPORT_CATALOG_UNSHARED = with_(EXPORTED) + """
SELECT id, CASE WHEN gone THEN true END AS deleted, CASE WHEN NOT gone THEN name END AS name, CASE WHEN NOT gone THEN urltemplate END AS urltemplate,
       CASE WHEN NOT gone THEN type END AS type, CASE WHEN NOT gone THEN mimetype END AS mimetype,
       CASE WHEN NOT gone THEN rate END AS maxqueriesperday, CASE WHEN NOT gone THEN directaccess END AS directaccess
FROM ex"""

DELETE_RESOURCES = with_(CATALOG) + """
SELECT id, name FROM old WHERE id NOT IN (SELECT id FROM upd WHERE deleted)"""

VALID_HITS = ALL_LINKS.replace("SELECT * FROM g WHERE title IS NOT NULL OR url IS NOT NULL",
                                   "SELECT page_id, pos, title FROM g WHERE title IS NOT NULL AND length(title) > 0")

LOCAL_SEARCH = local_search_sql(10, 0)


def made_items_sql(where: str, note: str, error: str, broken: bool = True) -> str:
    """The two items of every made page, and an error row for each broken one."""
    ok = f"({where}) AND c_custkey % 10 <> 3" if broken else where
    url = "'https://shop.example.org/c/' || CAST(c_custkey AS VARCHAR)"
    return f"""
SELECT c_custkey AS page_id, 1 AS pos, c_name AS title, {url} AS url, {note} AS note, CAST(NULL AS VARCHAR) AS error FROM customer WHERE {ok}
UNION ALL SELECT c_custkey, 2, 'second of ' || CAST(c_custkey AS VARCHAR), NULL, NULL, NULL FROM customer WHERE {ok}
UNION ALL SELECT c_custkey, 0, NULL, NULL, NULL, '{error}' FROM customer WHERE ({where}) AND c_custkey % 10 = 3 AND {broken}"""


def json_items_sql(where: str, note: str) -> str:
    """The four items of every made JSON page; members of an object come in the order of their names."""
    shift = made_items_sql(where, note, "Malformed JSON")
    more = "".join(f"""
UNION ALL SELECT c_custkey, {k}, '{t} of ' || CAST(c_custkey AS VARCHAR), NULL, NULL, NULL FROM customer WHERE ({where}) AND c_custkey % 10 <> 3"""
                   for k, t in ((1, "third"), (2, "fourth")))
    return f"SELECT page_id, CAST(CASE WHEN pos > 0 THEN pos + 2 ELSE 0 END AS INTEGER) AS pos, title, url, note, error FROM ({shift}) {more}"


EXTRACT_XML = made_items_sql("true", "c_mktsegment || ' x'", "Malformed XML")
EXTRACT_JSON = json_items_sql("true", "c_mktsegment || ' x'")
# every tenth page starts with an object of its own
EXTRACT_CALLBACK = f"""
SELECT page_id, CAST(pos + CASE WHEN page_id % 10 = 3 THEN 1 ELSE 0 END AS INTEGER) AS pos, title, url, note, error
FROM ({made_items_sql("true", "c_mktsegment || ' x'", "", broken=False)})
UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 3"""
EXTRACT_JSON_OF_HTML = made_items_sql("true", "c_mktsegment || ' x'", "Malformed JSON")
# a page that is broken off holds its first item still
EXTRACT_HTML_WITH_JSON = f"""
SELECT * FROM ({made_items_sql("true", "c_mktsegment || ' x'", "")}) WHERE pos > 0
UNION ALL SELECT * FROM ({made_items_sql("c_custkey % 10 = 3", "c_mktsegment || ' x'", "", broken=False)}) WHERE pos = 1"""
PARSE_RESOURCES = """
WITH s AS (SELECT *, s_suppkey % 7 > 0 AS whole FROM supplier WHERE s_suppkey % 9 <> 4)
SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN whole THEN 'https://{host?}/q={searchTerms}' END AS apitemplate,
  CASE WHEN whole THEN round(s_acctbal, 6) END AS prior, CAST(CASE WHEN whole THEN s_suppkey % 50 ELSE 1000 END AS INTEGER) AS maxqueriesperday,
  s_suppkey % 5 = 0 AS deleted, 'application/result-page+json' AS mimetype, 'test' AS testquery, CASE WHEN s_suppkey % 3 = 0 THEN './a/@href' END AS url_path,
  false AS bad
FROM s
UNION ALL SELECT NULL, s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 9 = 4"""
EXTRACT_RESULT_PAGES = f"""
WITH a AS ({made_items_sql("c_custkey % 5 = 0", "NULL", "Malformed JSON")}),
b AS ({made_items_sql("c_custkey % 5 = 1", "NULL", "Malformed XML")}),
c AS ({json_items_sql("c_custkey % 5 = 2", "NULL")})
SELECT page_id, pos, title, CASE WHEN pos = 1 THEN '/c/' || CAST(page_id AS VARCHAR) END AS url, error FROM a
UNION ALL SELECT page_id, pos, title, url, error FROM b UNION ALL SELECT page_id, pos, title, url, error FROM c
UNION ALL SELECT c_custkey, 0, NULL, NULL, CASE c_custkey % 5 WHEN 3 THEN 'MIME Type not supported: image/png' ELSE 'No rule for this resource' END
FROM customer WHERE c_custkey % 5 >= 3"""


URL_FUNCTIONS = f"""
WITH a AS (SELECT c_custkey, c_name || [' a&b', '$1', '"q"', 'é/ñ', '{{x}}', ''][c_custkey % 6 + 1] AS odd,
                  'https://idx.example.org/' || ['idx/idx?q={{q}}', 's?r=idx&k={{key?}}', 'none'][c_custkey % 3 + 1] AS own, c_mktsegment AS seg, c_acctbal
           FROM customer),
e AS (SELECT *, {ENC.format(x='odd')} AS enc, regexp_replace(own, '[?].*', '') AS cut FROM a),
f AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'https://idx.example.org/idx/' || enc || '?q=' WHEN 1 THEN 'https://idx.example.org/s?r=' || enc || '&k='
                     ELSE 'https://' || enc || '.example.org/none' END AS u FROM e)
SELECT c_custkey, trim(concat_ws(' ', odd, CASE WHEN c_custkey % 4 > 0 THEN seg END)) AS title_description,
       CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal, 6) ELSE 0.0 END AS score, u AS url, CAST(NULL AS VARCHAR) AS error,
       'No answer for {{key}} at end' AS redacted, cut AS template_key, cut || '?q={{searchTerms}}&page={{startPage?}}' AS normal,
       md5(odd) AS hash, regexp_replace(odd, '[^A-Z0-9a-z\\-_\\.]', '_', 'g') AS element
FROM f"""

CONTAINS_ID = with_(CATALOG) + """,
ids AS (SELECT DISTINCT 's' || CAST(user_id AS VARCHAR) AS id FROM events)
SELECT ids.id, old.id IS NOT NULL AS known, old.name FROM ids LEFT JOIN old ON old.id = ids.id"""

CHECK_IDS = with_(CATALOG) + """
SELECT id, 'reserved id' AS problem FROM upd WHERE id IN ('c1', 's2')
UNION ALL SELECT id, 'server id already exists' FROM old WHERE id = 's2'"""

TOMBSTONES = with_(CATALOG) + """,
x AS (SELECT old.*, old.id IN (SELECT id FROM upd WHERE deleted) AS gone FROM old)
SELECT id, CASE WHEN gone THEN true END AS deleted, CASE WHEN NOT gone THEN name END AS name,
       CASE WHEN NOT gone THEN apitemplate END AS apitemplate FROM x"""

UPDATE_ALLOWANCE = with_(CATALOG) + """,
u AS (SELECT 's' || CAST(user_id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1)
SELECT old.id, name, coalesce(u.n, 7) AS dayallowance FROM old LEFT JOIN u ON u.id = old.id"""

STRIP_PROVENANCE = with_(HITS) + """
SELECT doc_id, CASE WHEN type = 'en' THEN rid ELSE 'me' END AS rid, CASE WHEN type = 'en' THEN type END AS query, '2024-02-01' AS foundBefore FROM h"""

NOT_YET_SEEN = """
SELECT 'u' || CAST(c_custkey AS VARCHAR) AS rid FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"""

CACHED_RESULTS = with_(LOG) + """,
first AS (SELECT query, rid, arg_min(event_id, (ts, event_id)) AS page_id FROM log GROUP BY query, rid)
SELECT log.event_id AS req_id, 1 AS pos,
       '{' || CASE WHEN p.message IS NULL THEN '' ELSE '"title":' || CAST(to_json(p.message) AS VARCHAR) || ',' END || '"score":' || CAST(p.hits AS VARCHAR) || '}' AS hit
FROM log JOIN first USING (query, rid) JOIN log p ON p.event_id = first.page_id"""

LOCAL_PROJECTION = with_(CATALOG) + f"""
SELECT id, name, CAST(NULL AS VARCHAR) AS banner, CAST(NULL AS VARCHAR) AS favicon, 'https://www.example.org/suggest' AS suggesttemplate,
       '{DEFAULT_TESTQUERY}' AS testquery, '{DEFAULT_MIMETYPE}' AS mimetype FROM old"""

WITH_DEFAULT_HIT = with_(HITS) + """
SELECT hit_id, title, url, type FROM h
UNION ALL SELECT '@https://start.example.org', 'Welcome', 'https://start.example.org', 'web'"""

EXPORT_HITS = with_(HITS) + """
SELECT '{"hit_id":' || CAST(to_json(hit_id) AS VARCHAR) || ',"rid":' || CAST(to_json(rid) AS VARCHAR) || ',"type":' || CAST(to_json(type) AS VARCHAR) || '}' AS value FROM h"""

SAVED_CATALOG = f"SELECT id, name, type, prior, deleted, lastupdated FROM ({MERGE_RESOURCES})"

MATCHED_TEXTS = """
WITH t AS (SELECT DISTINCT url AS text FROM pages WHERE url IS NOT NULL),
w AS (SELECT DISTINCT unnest(string_split_regex(text, '[/.?=&:]+')) AS wanted FROM t)
SELECT wanted, count(*) AS n_texts, min(text) AS "first" FROM w JOIN t ON contains(text, wanted) GROUP BY wanted"""

RATE_LIMIT_STATEFUL = f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY rid ORDER BY ts DESC, req_id DESC) = 1 THEN allowance END AS "left" FROM ({RATE_LIMIT})"""

FREE_HITS = """
h AS (
  SELECT *, rid || '@' || url AS hit_id FROM (
    SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS rid, '/c/' || CAST(c_custkey AS VARCHAR) AS url,
           c_name || CASE WHEN second THEN ' new' ELSE '' END AS title, c_mktsegment || ' b' || CAST(c_custkey % 50 AS VARCHAR) AS description,
           CAST(NULL AS VARCHAR) AS type, second
    FROM (SELECT *, c_custkey % 2 = 1 OR c_custkey % 3 = 0 AS second FROM customer)))"""
SEARCH_INGESTED = with_(FREE_HITS, POSTINGS, QUERY_TERMS.replace(
    "SELECT item_id AS qid, text AS query FROM benchmark", "SELECT DISTINCT description AS qid, description AS query FROM h"), SCORED) + """
SELECT res.qid, res.rank, res.hit_id, round(res.score, 6) AS score, res.rid, res.title, res.url,
       CASE WHEN NOT h.second THEN h.description END AS tag, CASE WHEN h.second THEN h.description END AS label
FROM res JOIN h ON res.hit_id = h.hit_id"""


def refresh_sql(slices: int, budget: int, days: int) -> str:
    """The batches of the refresh job one after another; known(rid, at) holds when each resource was last updated."""
    parts = [f"""
WITH lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
e AS (SELECT 's' || CAST(user_id AS VARCHAR) AS rid, ts, CAST(least(floor((epoch_us(ts) - lo) * {slices} / greatest(1, hi - lo)), {slices - 1}) AS BIGINT) AS k FROM events, lim),
known0 AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS rid, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN {UP_SINCE} ELSE TIMESTAMP '2020-01-01 00:00:00' END AS at FROM supplier)"""]
    for k in range(slices):
        parts.append(f"""
now{k} AS (SELECT max(ts) AS now FROM e WHERE k = {k}),
asked{k} AS (
  SELECT s.rid, now, CAST(substr(s.rid, 2) AS BIGINT) % 7 <> 0 AS found FROM (SELECT DISTINCT rid FROM e WHERE k = {k}) s, now{k}
  LEFT JOIN known{k} c ON c.rid = s.rid
  WHERE c.at IS NULL OR floor(date_diff('millisecond', c.at, now) / 1000) > {days} * 86400
  ORDER BY s.rid LIMIT {budget}),
known{k + 1} AS (
  SELECT c.* FROM known{k} c WHERE c.rid NOT IN (SELECT rid FROM asked{k} WHERE found)
  UNION ALL SELECT rid, 'parent''s ' || rid, now FROM asked{k} WHERE found)""")
    log = " UNION ALL ".join(f"SELECT {k} AS batch_id, rid, found, now AS asked FROM asked{k}" for k in range(slices))
    return ",".join(parts) + f"""
SELECT CAST(l.batch_id AS BIGINT) AS batch_id, l.rid, l.found, l.asked, c.name, c.at AS lastupdated FROM ({log}) l LEFT JOIN known{slices} c ON c.rid = l.rid"""


REFRESH_STREAM = refresh_sql(4, 11, 10)

HIT_LOG = with_(HITS) + """
SELECT hit_id, rid, 'v' || CAST(greatest(doc_id % 4, CASE WHEN doc_id % 7 < 4 THEN doc_id % 7 ELSE 0 END) AS VARCHAR) || ' ' || title AS title FROM h"""
