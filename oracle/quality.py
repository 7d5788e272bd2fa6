"""Oracle SQL for cells, ingest, checks, coverage and leak scans."""

from __future__ import annotations

from oracle.base import BARS, CAPS, EVENTS, PAIRS
from oracle.universe import MEMBER

SQL: dict[str, str] = {}

SQL["numeric_cells"] = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN value * 1e6 WHEN 1 THEN -value WHEN 2 THEN -value
  WHEN 4 THEN -value WHEN 5 THEN value WHEN 6 THEN CAST(4000100 + (event_id % 1000) * 1000 AS DOUBLE) WHEN 7 THEN value * 1e9 END AS number,
  event_id % 8 = 7 AS suspicious FROM events"""
SQL["rating_date_parse"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 2 THEN CAST(o_orderdate AS DATE) END AS lenient,
  CASE WHEN o_orderkey % 6 IN (0, 3) OR (o_orderkey % 6 = 1 AND month(o_orderdate) = 5) THEN CAST(o_orderdate AS DATE) END AS strict
FROM orders"""

_RAW = """raw AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, o_custkey, o_orderkey,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pg, o_orderpriority, o_orderstatus, o_orderdate FROM orders),
f AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY as_of, o_custkey) - 1 AS n_dropped FROM raw
  WINDOW w AS (PARTITION BY as_of, o_custkey ORDER BY pg, o_orderkey))"""
SQL["dedupe_keep_first"] = f"WITH {_RAW} SELECT as_of, 'T' || o_custkey AS ticker, pg AS _page, o_orderkey AS _row, n_dropped FROM f WHERE rn = 1"
SQL["ingest_snapshot"] = f"""WITH {_RAW}
SELECT as_of, 'T' || o_custkey AS ticker, c_name AS company, c_mktsegment AS sector, (o_orderkey + 0.25e0) * 1e3 AS price,
  o_orderkey * 3e0 AS best_analyst_price_target, -((o_orderkey % 90) + 0.5e0) AS best_analyst_upside_pct,
  (o_orderkey % 70) + 0.25e0 AS analyst_price_target_upside_pct, o_orderkey * 2e0 * 1e6 AS analyst_price_target,
  substr(o_orderpriority, 3) AS analyst_consensus, strftime(o_orderdate, '%b %d, %Y') AS last_rating_date,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 10 + 1 AS DOUBLE) END AS smart_score, o_orderstatus AS insider_signal,
  CAST(NULL AS DOUBLE) AS dividend_yield, n_dropped
FROM f JOIN customer ON c_custkey = o_custkey WHERE rn = 1"""
SQL["capture_header"] = f"""WITH {_RAW}
SELECT 1 AS schema_version, as_of, strftime(as_of, '%A') AS as_of_weekday, isodow(as_of) >= 6 AS as_of_is_weekend,
  count(*) AS n_rows, CAST(sum(n_dropped) AS BIGINT) AS n_dropped, 'Volume' AS unmapped FROM f WHERE rn = 1 GROUP BY as_of"""

SQL["dq_checks"] = f"""WITH {CAPS},
kt AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, o_custkey, count(*) AS n, sum(o_orderkey) AS k FROM orders GROUP BY 1, 2),
h AS (SELECT kt.as_of, c.capture_ord, CAST(sum(n) AS BIGINT) AS n_raw, count(*) AS n_rows,
   sha256(CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(sum(k) AS BIGINT) AS VARCHAR)) AS sha
   FROM kt JOIN caps c ON c.as_of = kt.as_of GROUP BY 1, 2),
ov AS (SELECT c.capture_ord, count(*) AS common FROM kt a JOIN caps c ON c.as_of = a.as_of JOIN kt b ON b.as_of = c.prev_as_of AND b.o_custkey = a.o_custkey GROUP BY 1),
m AS (SELECT n.*, p.as_of AS p_as_of, p.n_rows AS p_rows, p.sha AS p_sha, coalesce(common, 0) AS common
   FROM h n LEFT JOIN h p ON p.capture_ord = n.capture_ord - 1 LEFT JOIN ov ON ov.capture_ord = n.capture_ord)
SELECT as_of, 'file readable' AS "check", n_raw > 0 AS ok, CAST(n_raw AS VARCHAR) AS detail FROM m
UNION ALL SELECT as_of, 'core columns present', TRUE, '' FROM m
UNION ALL SELECT as_of, 'no column regression', TRUE, '' FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'unmapped columns', TRUE, '' FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'row count vs prior', abs((n_raw - p_rows) / CAST(p_rows AS DOUBLE)) <= 0.05e0,
   CAST(round((n_raw - p_rows) / CAST(p_rows AS DOUBLE) * 100e0, 4) AS VARCHAR) FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'key overlap vs prior', common / CAST(p_rows AS DOUBLE) >= 0.9e0,
   CAST(round(common / CAST(p_rows AS DOUBLE) * 100e0, 4) AS VARCHAR) FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'export is fresh', sha <> p_sha, '' FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'prior capture', TRUE, 'none found' FROM m WHERE p_as_of IS NULL
UNION ALL SELECT as_of, 'as-of not in the future', as_of <= DATE '2001-06-01', CAST(as_of AS VARCHAR) FROM m
UNION ALL SELECT as_of, 'capture is after the prior one', as_of > p_as_of, CAST(p_as_of AS VARCHAR) FROM m WHERE p_as_of IS NOT NULL
UNION ALL SELECT as_of, 'not already captured', TRUE, '1' FROM m"""

SQL["asof_prior_capture"] = f"""WITH {CAPS}, {EVENTS},
d AS (SELECT CAST(cap_ts AS DATE) AS as_of, CASE WHEN strftime(cap_ts, '%H%M') = '0000' THEN '' ELSE strftime(cap_ts, '%H%M') END AS hhmm FROM cap)
SELECT d.as_of, d.hhmm, CASE WHEN x.as_of IS NOT NULL THEN 'daily' WHEN wk.as_of IS NOT NULL THEN 'weekly' END AS prior_stream,
  coalesce(x.as_of, wk.as_of) AS prior_as_of, CASE WHEN x.as_of IS NOT NULL THEN x.hhmm WHEN wk.as_of IS NOT NULL THEN '' END AS prior_hhmm
FROM d LEFT JOIN LATERAL (SELECT as_of, hhmm FROM d e WHERE (e.as_of, e.hhmm) < (d.as_of, d.hhmm) ORDER BY 1 DESC, 2 DESC LIMIT 1) x ON TRUE
LEFT JOIN LATERAL (SELECT as_of FROM caps WHERE caps.as_of < d.as_of OR (caps.as_of = d.as_of AND d.hhmm > '') ORDER BY 1 DESC LIMIT 1) wk ON TRUE"""

_COV = f"""{CAPS}, ses AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem),
cov AS (SELECT DISTINCT (SELECT max(session) FROM ses WHERE session <= as_of - 1) AS session FROM caps),
rng AS (SELECT min(session) AS lo, max(session) AS hi FROM cov),
c AS (SELECT ses.session, cov.session IS NOT NULL AS covered FROM ses JOIN rng ON ses.session BETWEEN lo AND hi LEFT JOIN cov ON cov.session = ses.session)"""
SQL["session_coverage"] = f"WITH {_COV} SELECT session, covered FROM c"
SQL["coverage_summary"] = f"""WITH {_COV} SELECT count(*) FILTER (covered) AS covered, count(*) AS in_range,
  round(CAST(count(*) FILTER (covered) AS DOUBLE) / count(*), 4) AS share, max(session) FILTER (covered) AS latest_anchor FROM c"""
SQL["slot_split"] = f"""WITH {EVENTS}, h AS (SELECT strftime(cap_ts, '%H%M') AS t FROM cap)
SELECT count(*) FILTER (t <> '0000' AND t < '2130') AS post_close, count(*) FILTER (t <> '0000' AND t >= '2130') AS intraday,
  count(*) FILTER (t = '0000') AS untimed FROM h"""
SQL["feed_gate"] = f"""WITH {BARS}, {MEMBER}, b(symbol) AS (VALUES ('BRAND-1'), ('BRAND-2'), ('BRAND-3')),
l AS (SELECT symbol, max(session) AS last_bar FROM bars WHERE symbol IN (SELECT symbol FROM b) GROUP BY 1),
d AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING max(CAST(l_shipdate AS DATE)) < DATE '2001-01-01'),
r AS (SELECT min(last_bar) AS oldest_benchmark_bar, count(*) AS benchmarks_found,
  (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE CAST(l_shipdate AS DATE) + INTERVAL 21 HOUR <= TIMESTAMP '2001-06-30 12:00:00') AS last_completed_session,
  (SELECT count(*) FROM d) AS delisted_symbols,
  (SELECT CAST(coalesce(sum(is_member), 0) AS BIGINT) FROM member WHERE symbol IN (SELECT symbol FROM b)) AS member_days FROM l)
SELECT *, benchmarks_found = 3 AND oldest_benchmark_bar >= last_completed_session AS fresh, delisted_symbols > 0 AS delisted_ok,
  member_days > 0 AS membership_ok FROM r"""
SQL["leak_scan"] = """WITH k AS (SELECT DISTINCT '/' || w AS key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) q)
SELECT key, count(*) AS n_rows FROM k JOIN pages ON contains(html, '"' || key || '"') GROUP BY key"""
SQL["guard_marker_scan"] = f"""WITH {PAIRS}, d(marker, hit) AS (VALUES ('"ticker"', TRUE), ('"company"', FALSE), ('"rows"', FALSE),
  ('"table"', FALSE), ('best_analyst_price_target', FALSE), ('last_rating_date', FALSE))
SELECT marker, CASE WHEN hit THEN (SELECT count(*) FROM em) ELSE 0 END AS n_rows FROM d"""
SQL["leak_offenders"] = SQL["leak_scan"] + " ORDER BY key LIMIT 10"

_ATTEMPTS = """p AS (SELECT *, CASE WHEN year(o_orderdate) <= 1996 THEN 1 WHEN year(o_orderdate) <= 1998 THEN 2 ELSE 3 END AS period,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pg FROM orders JOIN customer ON c_custkey = o_custkey),
f AS (SELECT *, row_number() OVER (PARTITION BY period, o_custkey ORDER BY pg, o_orderkey) AS rn FROM p),
n AS (SELECT period, count(*) AS n_raw, count(DISTINCT o_custkey) AS n_rows FROM p GROUP BY 1),
-- attempt, date, export, export of the newest earlier capture, filed
a(attempt, as_of, cur, pri, filed) AS (VALUES (1, DATE '1996-12-31', 1, NULL, TRUE), (2, DATE '1997-06-30', 1, 1, FALSE), (3, DATE '1998-06-30', 2, 1, FALSE),
  (4, DATE '1998-12-31', 2, 1, TRUE), (5, DATE '1998-12-31', 3, 1, FALSE), (6, DATE '2001-12-31', 3, 2, TRUE), (7, DATE '2002-06-30', 3, 3, FALSE)),
d(period, day) AS (VALUES (1, DATE '1996-12-31'), (2, DATE '1998-12-31'), (3, DATE '2001-12-31')),
m AS (SELECT a.*, c.n_raw, q.n_rows AS p_rows, d.day AS p_day, attempt = 3 AS lost,
   (SELECT count(*) FROM (SELECT o_custkey FROM p WHERE period = cur INTERSECT SELECT o_custkey FROM p WHERE period = pri)) AS common
  FROM a JOIN n c ON c.period = cur LEFT JOIN n q ON q.period = pri LEFT JOIN d ON d.period = pri)"""
SQL["capture_flow"] = f"""WITH {_ATTEMPTS}
SELECT attempt, as_of, 'file readable' AS "check", n_raw > 0 AS ok, CAST(n_raw AS VARCHAR) AS detail FROM m
UNION ALL SELECT attempt, as_of, 'core columns present', NOT lost, CASE WHEN lost THEN 'smart_score' ELSE '' END FROM m
UNION ALL SELECT attempt, as_of, 'no column regression', NOT lost, CASE WHEN lost THEN 'smart_score' ELSE '' END FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'unmapped columns', TRUE, CASE WHEN lost THEN 'Points' ELSE '' END FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'row count vs prior', abs((n_raw - p_rows) / CAST(p_rows AS DOUBLE)) <= 5e0,
  CAST(round((n_raw - p_rows) / CAST(p_rows AS DOUBLE) * 100e0, 4) AS VARCHAR) FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'key overlap vs prior', common / CAST(p_rows AS DOUBLE) >= 0.3e0, CAST(round(common / CAST(p_rows AS DOUBLE) * 100e0, 4) AS VARCHAR)
  FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'export is fresh', cur <> pri, '' FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'prior capture', TRUE, 'none found' FROM m WHERE pri IS NULL
UNION ALL SELECT attempt, as_of, 'as-of not in the future', attempt <> 7, CAST(as_of AS VARCHAR) FROM m
UNION ALL SELECT attempt, as_of, 'capture is after the prior one', as_of > p_day, CAST(p_day AS VARCHAR) FROM m WHERE pri IS NOT NULL
UNION ALL SELECT attempt, as_of, 'not already captured', attempt <> 5, CASE attempt WHEN 5 THEN '2' ELSE '1' END FROM m
UNION ALL SELECT attempt, as_of, 'filed', filed, '' FROM m
UNION ALL SELECT 0, day, 'held', TRUE, count(*) FILTER (rn = 1) || ' ' || CAST(sum(o_orderkey * 1000 + 250) FILTER (rn = 1) AS BIGINT) || ' ' ||
  count(*) FILTER (rn > 1) || ' ' || count(*) || ' Volume' FROM f JOIN d ON d.period = f.period GROUP BY day"""
SQL["quarantined_documents"] = """SELECT coalesce(source, 'none') AS source, count(*) FILTER (coalesce(lang <> 'de', TRUE)) AS records,
  CAST(coalesce(sum(length(text)) FILTER (coalesce(lang <> 'de', TRUE)), 0) AS BIGINT) AS chars, count(*) FILTER (lang = 'de') AS quarantined,
  CAST(coalesce(sum(length('{doc_id":' || doc_id || ',"lang":"de","n":' || length(text) || '}')) FILTER (lang = 'de'), 0) AS BIGINT) AS held_chars
FROM documents GROUP BY 1"""
