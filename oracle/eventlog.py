"""Oracle SQL for the event-log and identity families."""

from __future__ import annotations

from oracle.base import EVENTS, rnd

SQL: dict[str, str] = {}

SWEEP = f"""{EVENTS},
cp AS (SELECT a.capture_ord AS a_ord, b.capture_ord AS b_ord, a.et AS a_et, b.et AS b_et FROM cap a JOIN cap b ON a.capture_ord < b.capture_ord),
hit AS (SELECT a_ord, b_ord, x.lab AS la, y.lab AS lb, y.rating_date BETWEEN CAST(a_et AS DATE) AND CAST(b_et AS DATE) AS conf
  FROM cp JOIN elog x ON x.capture_ord = a_ord JOIN elog y ON y.capture_ord = b_ord AND y.ticker = x.ticker),
sw0 AS (SELECT cp.a_ord, cp.b_ord, count(la) AS paired, count(*) FILTER (la <> lb) AS changes, count(*) FILTER (lb < la) AS up,
  count(*) FILTER (lb > la) AS down, count(*) FILTER (la <> lb AND conf) AS confirmed,
  {rnd("date_diff('microsecond', any_value(a_et), any_value(b_et)) / 3600000000e0", 4)} AS hours,
  CAST(date_diff('day', CAST(any_value(a_et) AS DATE), CAST(any_value(b_et) AS DATE)) + 1 AS INTEGER) AS span
  FROM cp LEFT JOIN hit ON hit.a_ord = cp.a_ord AND hit.b_ord = cp.b_ord GROUP BY 1, 2),
sw AS (SELECT *, CASE WHEN changes > 0 THEN round(CAST(confirmed AS DOUBLE) / changes, 4) END AS rate FROM sw0),
us AS (SELECT * FROM sw WHERE changes >= 3)"""
SQL["confirm_sweep_pairs"] = f"WITH {SWEEP} SELECT * FROM sw"
_SHARE = "CAST(sum(changes) AS BIGINT) AS changes, CAST(sum(confirmed) AS BIGINT) AS confirmed, round(CAST(sum(confirmed) AS DOUBLE) / nullif(sum(changes), 0), 4) AS rate"
SQL["confirm_by_elapsed"] = f"""WITH {SWEEP},
d(bucket, lo, hi) AS (VALUES ('< 1 day', 0, 24), ('1-2 days', 24, 48), ('2-4 days', 48, 96), ('4+ days', 96, 1000000000))
SELECT bucket, count(changes) AS pairs, CAST(coalesce(sum(changes), 0) AS BIGINT) AS changes,
  CAST(coalesce(sum(confirmed), 0) AS BIGINT) AS confirmed, round(CAST(sum(confirmed) AS DOUBLE) / nullif(sum(changes), 0), 4) AS rate
FROM d LEFT JOIN us ON hours >= lo AND hours < hi GROUP BY bucket"""
SQL["confirm_by_span"] = f"WITH {SWEEP} SELECT span, count(*) AS pairs, {_SHARE} FROM us GROUP BY span"
SQL["confirm_within_span"] = f"""WITH {SWEEP},
k AS (SELECT *, count(*) OVER (PARTITION BY span) AS n, row_number() OVER (PARTITION BY span ORDER BY hours, a_ord, b_ord) AS pos,
  max(hours) OVER (PARTITION BY span) - min(hours) OVER (PARTITION BY span) AS rng FROM us)
SELECT span, CASE WHEN pos <= n // 2 THEN 'shorter' ELSE 'longer' END AS half, min(hours) AS from_hours, max(hours) AS to_hours, {_SHARE}
FROM k WHERE n >= 2 AND rng >= 6 GROUP BY 1, 2"""

FLOW = f"""{EVENTS},
mv AS (SELECT b.capture_ord AS w, b.ticker, (b.best_target - a.best_target) / a.best_target * 100e0 AS pct,
   b.rating_date BETWEEN CAST(a.et AS DATE) AND CAST(b.et AS DATE) AS dated
 FROM elog b JOIN elog a ON a.ticker = b.ticker AND a.capture_ord = b.capture_ord - 1 WHERE a.best_target <> 0),
mvk AS (SELECT w, ticker, {rnd('pct', 4)} AS move, dated FROM mv WHERE abs(pct) >= 0.25e0),
fw AS (SELECT b.capture_ord AS w, a.et AS a_et, b.et AS b_et FROM cap b JOIN cap a ON a.capture_ord = b.capture_ord - 1),
fwin AS (SELECT fw.w, CASE WHEN CAST(a_et AS DATE) <> CAST(b_et AS DATE) THEN 'overnight' WHEN CAST(a_et AS TIME) < TIME '09:30' THEN 'pre-open'
    WHEN CAST(b_et AS TIME) <= TIME '16:00' THEN 'intra-session' ELSE 'session+close' END AS kind,
  {rnd("date_diff('microsecond', a_et, b_et) / 3600000000e0", 4)} AS hours,
  coalesce(paired, 0) AS paired, coalesce(moves, 0) AS moves, coalesce(raises, 0) AS raises, coalesce(cuts, 0) AS cuts,
  round(CAST(dated AS DOUBLE) / nullif(moves, 0), 4) AS dated_share
 FROM fw LEFT JOIN (SELECT w, count(*) AS paired FROM mv GROUP BY 1) p ON p.w = fw.w
 LEFT JOIN (SELECT w, count(*) AS moves, count(*) FILTER (move > 0) AS raises, count(*) FILTER (move <= 0) AS cuts,
   count(*) FILTER (dated) AS dated FROM mvk GROUP BY 1) m ON m.w = fw.w)"""
SQL["target_flow_windows"] = f"WITH {FLOW} SELECT * FROM fwin"
SQL["target_flow_overlap"] = f"""WITH {FLOW}, n AS (SELECT w, count(*) AS moves FROM mvk GROUP BY 1),
s AS (SELECT b.w, count(*) AS shared, count(*) FILTER (a.move = b.move) AS identical FROM mvk b JOIN mvk a ON a.ticker = b.ticker AND a.w = b.w - 1 GROUP BY 1)
SELECT nb.w - 1 AS window_a, nb.w AS window_b, na.moves AS moves_a, nb.moves AS moves_b, coalesce(shared, 0) AS shared,
  coalesce(identical, 0) AS identical, coalesce(identical > 0 AND identical = shared, FALSE) AS duplicate
FROM n nb JOIN n na ON na.w = nb.w - 1 LEFT JOIN s ON s.w = nb.w"""
SQL["target_flow_night_day"] = f"""WITH {FLOW}
SELECT CASE WHEN kind IN ('overnight', 'pre-open') THEN 'night' ELSE 'day' END AS class, count(*) AS windows,
  string_agg(CAST(moves AS VARCHAR), ',' ORDER BY w) AS moves FROM fwin GROUP BY 1"""

IDENT = f"""{EVENTS},
i0 AS (SELECT ticker, capture_ord, best_target, rating_date, {rnd('best_target', 4)} AS v FROM elog),
i1 AS (SELECT *, lag(v) OVER (PARTITION BY ticker ORDER BY capture_ord) AS before,
  min(capture_ord) OVER (PARTITION BY ticker, v) AS seen FROM i0),
cls AS (SELECT ticker, count(*) FILTER (abs(v / before - 1) * 100 >= 0.25e0) AS moves,
  coalesce(bool_or(v <> before AND seen < capture_ord), FALSE) AS reverted, count(DISTINCT rating_date) <= 1 AS rating_static
  FROM i1 GROUP BY ticker HAVING count(*) FILTER (best_target <> 0) = (SELECT count(*) FROM cap)),
arms AS (SELECT count(*) FILTER (rating_static) AS n1, count(*) FILTER (rating_static AND reverted) AS x1,
  count(*) FILTER (NOT rating_static) AS n2, count(*) FILTER (NOT rating_static AND reverted) AS x2 FROM cls WHERE moves > 0)"""
SQL["identity_classify"] = f"WITH {IDENT} SELECT * FROM cls"
SQL["identity_contingency"] = f"""WITH {IDENT}, d(rating_static, reverted) AS (VALUES (TRUE, TRUE), (TRUE, FALSE), (FALSE, TRUE), (FALSE, FALSE))
SELECT d.rating_static, d.reverted, count(c.ticker) AS names, CAST(coalesce(sum(c.moves), 0) AS BIGINT) AS moves
FROM d LEFT JOIN cls c ON c.rating_static = d.rating_static AND c.reverted = d.reverted AND c.moves > 0 GROUP BY 1, 2"""
SQL["identity_ztest"] = f"""WITH {IDENT},
a AS (SELECT *, x1 / nullif(CAST(n1 AS DOUBLE), 0) AS p1, x2 / nullif(CAST(n2 AS DOUBLE), 0) AS p2, (x1 + x2) / nullif(CAST(n1 + n2 AS DOUBLE), 0) AS pool FROM arms),
b AS (SELECT *, sqrt(pool * (1 - pool) * (1e0 / nullif(n1, 0) + 1e0 / nullif(n2, 0))) AS se FROM a),
z AS (SELECT *, CASE WHEN se > 0 THEN (p1 - p2) / se WHEN se = 0 THEN 0e0 END AS zz FROM b),
t AS (SELECT *, abs(zz) / sqrt(2e0) AS x, 1e0 / (1e0 + 0.3275911e0 * abs(zz) / sqrt(2e0)) AS t FROM z),
p AS (SELECT *, (0.254829592e0 * t - 0.284496736e0 * t ** 2 + 1.421413741e0 * t ** 3 - 1.453152027e0 * t ** 4 + 1.061405429e0 * t ** 5) * exp(-x * x) AS pv FROM t)
SELECT n1, x1, n2, x2, {rnd('p1', 6)} AS p_static, {rnd('p2', 6)} AS p_changed, {rnd('p1 / nullif(p2, 0)', 6)} AS ratio,
  {rnd('zz', 6)} AS z, {rnd('pv', 6)} AS p_value, coalesce(pv < 0.05 AND p1 > p2, FALSE) AS discriminates, least(n1, n2) < 50 AS caution FROM p"""
SQL["present_throughout"] = f"WITH {EVENTS} SELECT ticker, count(*) AS captures FROM elog GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM cap)"

SQL["stream_revision"] = f"""WITH {EVENTS}
SELECT b.capture_ord AS w, count(*) AS paired, count(*) FILTER (b.lab < a.lab) AS upgrades, count(*) FILTER (b.lab > a.lab) AS downgrades,
  count(*) FILTER (b.best_target / a.best_target - 1 >= 0.0025e0) AS raises, count(*) FILTER (b.best_target / a.best_target - 1 <= -0.0025e0) AS cuts
FROM elog b JOIN elog a ON a.ticker = b.ticker AND a.capture_ord = b.capture_ord - 1 GROUP BY 1"""
SQL["stream_windows"] = SQL["target_flow_windows"]
SQL["stream_late"] = f"""WITH {EVENTS}, h AS (SELECT max(capture_ord) AS top, CAST(floor(max(capture_ord) / 2e0) AS INTEGER) AS half FROM cap),
a AS (SELECT elog.*, half, top, capture_ord <= half AND (capture_ord = 1 OR coalesce(lab = 2, FALSE)) AS late FROM elog, h),
r AS (SELECT *, cap_ts IN (SELECT cap_ts FROM a WHERE NOT late) AS known FROM a WHERE late OR capture_ord = top)
SELECT r.ticker, strftime(r.cap_ts, '%Y-%m-%d %H:%M:%S') AS captured,
  CASE WHEN NOT known THEN 'capture not after the last one' ELSE 'record not after the last one' END AS reason
FROM r WHERE NOT known OR EXISTS (SELECT 1 FROM a WHERE a.ticker = r.ticker AND NOT a.late AND a.cap_ts >= r.cap_ts)"""
SQL["stream_distinct_captures"] = "SELECT DISTINCT sha256(props) AS sha256 FROM events"
SQL["identity_examples"] = f"""WITH {IDENT} SELECT ticker, moves FROM cls WHERE moves > 0 AND reverted AND rating_static
ORDER BY moves DESC, ticker LIMIT 12"""
