"""Oracle SQL for the symbol, membership and liquidity family."""

from __future__ import annotations

from oracle.base import BARS, CAPS, SYMBOL, rnd

SQL: dict[str, str] = {}

TICK = """tick AS (
  SELECT DISTINCT replace(p_brand, '#', CASE p_type WHEN 'ECONOMY' THEN '.' WHEN 'SMALL' THEN '-' WHEN 'STANDARD' THEN '/'
    WHEN 'PROMO' THEN '_' ELSE '-' END) AS ticker, p_type AS sector FROM part)"""
RES = f"""cand AS (
  SELECT ticker, 1 AS pos, upper(ticker) AS symbol FROM tick
  UNION ALL SELECT ticker, 2, upper(replace(ticker, '.', '-')) FROM tick
  UNION ALL SELECT ticker, 3, upper(replace(ticker, '-', '.')) FROM tick
  UNION ALL SELECT ticker, 4, upper(replace(ticker, '.', ' ')) FROM tick
  UNION ALL SELECT ticker, 5, upper(replace(ticker, '/', '.')) FROM tick),
res AS (SELECT t.ticker, (SELECT min_by(c.symbol, c.pos) FROM cand c
          WHERE c.ticker = t.ticker AND c.symbol IN (SELECT symbol FROM bars)) AS feed_symbol
        FROM (SELECT DISTINCT ticker FROM tick) t)"""
STATS = """s0 AS (SELECT *, close_capital * volume AS dv, close / lag(close) OVER w - 1 AS ret, lag(close, 63) OVER w AS base
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)),
stats AS (SELECT symbol, session, close, median(dv) OVER w21 AS adv_usd,
  CASE WHEN base > 0 THEN (close / base - 1) * 100 END AS tr_3m_pct,
  CASE WHEN count(ret) OVER w63 >= 40 THEN stddev_samp(ret) OVER w63 * sqrt(252e0) * 100 END AS vol_ann_pct
  FROM s0 WINDOW w21 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
                 w63 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""
MEMBER = f"""member AS (SELECT {SYMBOL} AS symbol, CASE WHEN l_linestatus = 'F' THEN 'S&P 500' ELSE 'S&P MidCap 400' END AS index_name,
  CAST(l_shipdate AS DATE) AS session, CASE WHEN sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE 0 END AS is_member
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""
OMEMBER = """member AS (SELECT o_custkey AS symbol, o_orderpriority AS index_name, CAST(o_orderdate AS DATE) AS session,
  max_by(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, o_orderkey) AS is_member FROM orders GROUP BY 1, 2, 3)"""

SQL["symbol_resolution"] = f"WITH {BARS}, {TICK}, {RES} SELECT ticker, feed_symbol, feed_symbol IS NOT NULL AS matched FROM res"
SQL["adv_median_21"] = f"WITH {BARS}, {STATS} SELECT symbol, session, {rnd('adv_usd', 4)} AS adv_usd FROM stats"
SQL["return_63"] = f"WITH {BARS}, {STATS} SELECT symbol, session, {rnd('tr_3m_pct', 6)} AS tr_3m_pct FROM stats"
SQL["vol_63"] = f"WITH {BARS}, {STATS} SELECT symbol, session, {rnd('vol_ann_pct', 6)} AS vol_ann_pct FROM stats"
SQL["chart_ma"] = f"""WITH {BARS}, c AS (SELECT symbol, session, {rnd('close', 2)} AS close,
  CASE WHEN count(*) OVER w50 = 50 THEN {rnd('avg(close) OVER w50', 2)} END AS ma50,
  CASE WHEN count(*) OVER w200 = 200 THEN {rnd('avg(close) OVER w200', 2)} END AS ma200,
  row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars WHERE session <= DATE '2000-12-31'
  WINDOW w50 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
         w200 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT symbol, session, close, ma50, ma200 FROM c WHERE k <= 262"""

SQL["asof_membership"] = f"""WITH {CAPS}, {OMEMBER},
k AS (SELECT DISTINCT symbol, index_name FROM member)
SELECT k.symbol, k.index_name, as_of, (SELECT max_by(is_member, session) FROM member m
  WHERE m.symbol = k.symbol AND m.index_name = k.index_name AND m.session <= caps.as_of) AS is_member
FROM k CROSS JOIN caps WHERE is_member = 1"""

SQL["asof_anchor_close"] = f"""WITH {CAPS}, {BARS}
SELECT s.symbol, caps.as_of, max(b.session) AS anchor_date, {rnd('max_by(b.close, b.session)', 6)} AS close_tr
FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN caps LEFT JOIN bars b ON b.symbol = s.symbol AND b.session <= caps.as_of
GROUP BY 1, 2"""

PANEL = f"""{CAPS}, {BARS}, {TICK}, {RES}, {STATS}, {MEMBER},
anch AS (SELECT s.symbol, caps.as_of, max(st.session) AS anchor_date, max_by(st.close, st.session) AS close_tr,
   max_by(adv_usd, st.session) FILTER (adv_usd IS NOT NULL) AS adv_usd,
   arg_max_null(tr_3m_pct, st.session) FILTER (st.close IS NOT NULL) AS tr_3m_pct,
   arg_max_null(vol_ann_pct, st.session) FILTER (st.close IS NOT NULL) AS vol_ann_pct
 FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN caps LEFT JOIN stats st ON st.symbol = s.symbol AND st.session <= caps.as_of
 GROUP BY 1, 2),
mem AS (SELECT k.symbol, k.index_name, caps.as_of, (SELECT max_by(is_member, session) FROM member m WHERE m.symbol = k.symbol
   AND m.index_name = k.index_name AND m.session <= caps.as_of) AS is_member
 FROM (SELECT DISTINCT symbol, index_name FROM member) k CROSS JOIN caps),
merged AS (SELECT caps.as_of, t.ticker, t.sector, r.feed_symbol, r.feed_symbol IS NOT NULL AS matched,
   coalesce(m1.is_member, 0) = 1 AS in500, coalesce(m2.is_member, 0) = 1 AS in400, anchor_date, close_tr, adv_usd, tr_3m_pct, vol_ann_pct
 FROM caps CROSS JOIN tick t JOIN res r ON r.ticker = t.ticker
 LEFT JOIN anch a ON a.symbol = r.feed_symbol AND a.as_of = caps.as_of
 LEFT JOIN mem m1 ON m1.symbol = r.feed_symbol AND m1.as_of = caps.as_of AND m1.index_name = 'S&P 500'
 LEFT JOIN mem m2 ON m2.symbol = r.feed_symbol AND m2.as_of = caps.as_of AND m2.index_name = 'S&P MidCap 400')"""
SQL["panel_merge"] = f"""WITH {PANEL}
SELECT as_of, ticker, sector, feed_symbol, matched, concat_ws('|', CASE WHEN in500 THEN 'S&P 500' END,
  CASE WHEN in400 THEN 'S&P MidCap 400' END) AS member_of, anchor_date, {rnd('close_tr', 6)} AS close_tr,
  {rnd('adv_usd', 4)} AS adv_usd, {rnd('tr_3m_pct', 6)} AS tr_3m_pct, {rnd('vol_ann_pct', 6)} AS vol_ann_pct,
  matched AND (in500 OR in400) AS in_universe,
  matched AND (in500 OR in400) AND coalesce(close_tr >= 5, FALSE) AND coalesce(adv_usd >= 20000, FALSE) AS liquid
FROM merged"""
SQL["liquid_funnel"] = f"""WITH {PANEL}
SELECT as_of, count(*) AS snapshot, count(*) FILTER (matched) AS matched, count(*) FILTER (matched AND (in500 OR in400)) AS in_universe,
  count(*) FILTER (matched AND (in500 OR in400) AND coalesce(close_tr >= 5, FALSE) AND coalesce(adv_usd >= 20000, FALSE)) AS liquid
FROM merged GROUP BY 1"""
