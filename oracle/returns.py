"""Oracle SQL for forward returns, trailing beta and drift adjustment."""

from __future__ import annotations

from oracle.base import BARS, CAPS, MARKET, PART_BARS, rnd

SQL: dict[str, str] = {}


def back3(d: str) -> str:
    """Three business days back: weekends first move to Monday."""
    return (
        f"CASE isodow({d}) WHEN 1 THEN {d} - 5 WHEN 2 THEN {d} - 5 WHEN 3 THEN {d} - 5 WHEN 4 THEN {d} - 3 "
        f"WHEN 5 THEN {d} - 3 WHEN 6 THEN {d} - 3 ELSE {d} - 4 END"
    )


def fwd(bars: str, horizons: str, known: str = "") -> str:
    k = f"coalesce({known}, l.sym_last < {back3('feed.d')})" if known else f"l.sym_last < {back3('feed.d')}"
    return f"""feed AS (SELECT max(session) AS d FROM {bars}),
anc AS (SELECT s.symbol, a.as_of FROM (SELECT DISTINCT symbol FROM {bars}) s CROSS JOIN (SELECT as_of FROM caps UNION SELECT d FROM feed) a),
last AS (SELECT symbol, max(session) AS sym_last FROM {bars} GROUP BY 1),
en AS (SELECT anc.symbol, anc.as_of, b.session AS entry_date, b.close AS entry FROM anc ASOF LEFT JOIN {bars} b ON b.symbol = anc.symbol AND b.session <= anc.as_of),
hz AS (SELECT en.*, h.horizon, CAST(CASE h.horizon WHEN '1w' THEN entry_date + INTERVAL 7 DAY WHEN '1m' THEN entry_date + INTERVAL 1 MONTH
   ELSE entry_date + INTERVAL 3 MONTH END AS DATE) AS end_date FROM en CROSS JOIN (SELECT unnest({horizons}) AS horizon) h),
xt AS (SELECT hz.*, b.session AS xd, b.close AS xc FROM hz ASOF LEFT JOIN {bars} b ON b.symbol = hz.symbol AND b.session <= hz.end_date),
dl AS (SELECT xt.*, l.sym_last, feed.d AS feed_end, ({k}) AND l.sym_last < end_date AS ended FROM xt JOIN last l ON l.symbol = xt.symbol CROSS JOIN feed),
rs AS (SELECT *, CASE WHEN entry_date IS NULL THEN 'no bar at or before anchor' WHEN entry <= 0 THEN 'non-positive entry price'
   WHEN NOT ended AND feed_end < end_date THEN 'horizon not matured'
   WHEN NOT ended AND sym_last < {back3('end_date')} THEN 'series ends ' || sym_last || ' before a matured horizon ending ' || end_date || ', and not flagged delisted'
   WHEN xd = entry_date THEN 'no bars after anchor' WHEN ended THEN 'delisted in window' ELSE 'ok' END AS reason FROM dl),
fr AS (SELECT symbol, as_of, horizon, entry_date, CASE WHEN reason IN ('ok', 'delisted in window') THEN xd END AS exit_date,
   CASE WHEN reason IN ('ok', 'delisted in window') THEN xc / entry - 1e0 END AS ret_frac,
   coalesce(ended, FALSE) AND reason IN ('no bars after anchor', 'delisted in window') AS delisted, reason FROM rs)"""


_OUT = f"SELECT symbol, as_of, horizon, entry_date, exit_date, {rnd('ret_frac', 6)} AS ret_frac, delisted, reason FROM fr"
_ALL = "['1w', '1m', '3m']"
SQL["forward_returns"] = f"WITH {CAPS}, {PART_BARS}, {fwd('pbars', _ALL)} {_OUT}"
SQL["forward_returns_known"] = f"""WITH {CAPS}, {PART_BARS},
kn AS (SELECT symbol, max(session) < DATE '2001-03-01' AS gone FROM pbars GROUP BY 1),
{fwd('pbars', _ALL, "(SELECT gone FROM kn WHERE kn.symbol = xt.symbol)")} {_OUT}"""

RISK = f"""sr AS (SELECT symbol, session, ret, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn FROM
   (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1e0 AS ret FROM bars) q WHERE ret IS NOT NULL),
mr AS (SELECT session, ret, row_number() OVER (ORDER BY session) AS rn FROM
   (SELECT session, close / lag(close) OVER (ORDER BY session) - 1e0 AS ret FROM market) q WHERE ret IS NOT NULL),
ran AS (SELECT s.symbol, caps.as_of FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN caps),
ra AS (SELECT ran.*, (SELECT count(*) FROM sr WHERE sr.symbol = ran.symbol AND sr.session <= ran.as_of) AS ks,
   (SELECT count(*) FROM mr WHERE mr.session <= ran.as_of) AS km FROM ran),
rj AS (SELECT ra.symbol, ra.as_of, sr.ret AS s, mr.ret AS m FROM ra JOIN sr ON sr.symbol = ra.symbol AND sr.rn <= ks AND sr.rn > ks - 252
   JOIN mr ON mr.session = sr.session AND mr.rn <= km AND mr.rn > km - 252),
rk AS (SELECT ra.symbol, ra.as_of, count(s) AS n, covar_samp(s, m) AS cov, var_samp(m) AS v, avg(s) AS sm, avg(m) AS mm
   FROM ra LEFT JOIN rj ON rj.symbol = ra.symbol AND rj.as_of = ra.as_of GROUP BY 1, 2),
risk AS (SELECT symbol, as_of, n, CASE WHEN n >= 120 AND v > 0 THEN cov / v END AS beta,
   CASE WHEN n >= 120 AND v > 0 THEN sm - cov / v * mm END AS drift,
   CASE WHEN n < 120 THEN 'only ' || n || ' overlapping sessions, need 120' WHEN v > 0 THEN 'ok' ELSE 'market variance is zero' END AS reason FROM rk)"""
SQL["trailing_beta"] = f"""WITH {CAPS}, {BARS}, {MARKET}, {RISK}
SELECT symbol, as_of, {rnd('beta', 6)} AS beta, {rnd('drift', 6)} AS drift_per_session, n AS n_sessions, reason FROM risk"""
SQL["drift_adjusted"] = f"""WITH {CAPS}, {BARS}, {MARKET}, {RISK}, {fwd('bars', "['1m', '3m']")}
SELECT fr.symbol, fr.as_of, fr.horizon, {rnd('ret_frac', 6)} AS ret_frac, {rnd('m2.close / m1.close - 1e0', 6)} AS market_ret,
  (SELECT CAST(count(*) AS INTEGER) FROM market m WHERE m.session > fr.entry_date AND m.session <= fr.exit_date) AS n_sessions_held,
  {rnd('ret_frac - beta * (m2.close / m1.close - 1e0) - drift * (SELECT count(*) FROM market m WHERE m.session > fr.entry_date AND m.session <= fr.exit_date)', 5)} AS alpha
FROM fr JOIN risk ON risk.symbol = fr.symbol AND risk.as_of = fr.as_of LEFT JOIN market m1 ON m1.session = fr.entry_date
LEFT JOIN market m2 ON m2.session = fr.exit_date WHERE ret_frac IS NOT NULL"""
SQL["drift_adjusted_all"] = SQL["drift_adjusted"].replace("['1m', '3m']", _ALL)
_D = "CAST(o_orderdate AS DATE)"
SQL["business_days_back"] = f"SELECT o_orderkey, {back3(_D)} AS shifted FROM orders"
SQL["session_snap"] = f"""SELECT o_orderkey, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE)) AS snapped FROM orders"""
