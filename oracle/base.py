"""Shared SQL fragments: DuckDB views of the same panel, price, membership and event-log roles."""

from __future__ import annotations


def rnd(x: str, n: int) -> str:
    """Round half up on the printed decimal value, as Spark does for doubles."""
    return f"CAST(round(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 15)), {n}) AS DOUBLE)"


def rank(c: str) -> str:
    return (
        f"CASE {c} WHEN 'Strong Buy' THEN 0 WHEN 'Moderate Buy' THEN 1 WHEN 'Hold' THEN 2 "
        f"WHEN 'Moderate Sell' THEN 3 WHEN 'Strong Sell' THEN 4 END"
    )


CAPS = """
caps AS (
  SELECT as_of, CAST(row_number() OVER (ORDER BY as_of) AS INTEGER) AS capture_ord,
         lag(as_of) OVER (ORDER BY as_of) AS prev_as_of, lead(as_of) OVER (ORDER BY as_of) AS next_as_of
  FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of FROM orders) q)"""

PANEL = CAPS + """,
st AS (
  SELECT c.*, o.*, row_number() OVER (PARTITION BY c.as_of, o.o_custkey
                                      ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
  FROM caps c JOIN orders o ON CAST(o.o_orderdate AS DATE) <= c.as_of),
panel0 AS (
  SELECT as_of, capture_ord, prev_as_of, next_as_of, o_custkey AS ticker,
    nullif(c_mktsegment, 'MACHINERY') AS sector,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Strong Buy' WHEN '2-HIGH' THEN 'Moderate Buy'
      WHEN '3-MEDIUM' THEN 'Hold' WHEN '5-LOW' THEN 'Moderate Sell' END AS label,
    CASE WHEN o_totalprice >= 10000 THEN 100e0 + floor(o_totalprice / 62500e0) * 0.1e0 END AS best_target,
    o_totalprice AS target, (o_totalprice - 250000e0) / 5000e0 AS upside,
    (o_totalprice - 100000e0) / 10000e0 AS best_upside,
    CAST(o_orderdate AS DATE) - CAST(o_orderkey % 120 AS INTEGER) AS rating_date,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
      ELSE CAST(o_orderkey % 10 + 1 AS DOUBLE) END AS score,
    CASE o_orderstatus WHEN 'P' THEN 'Positive' WHEN 'F' THEN 'Negative' END AS insider,
    CASE WHEN o_totalprice < 100000 THEN 'Bearish' WHEN o_totalprice < 400000 THEN 'Neutral' ELSE 'Bullish' END AS news,
    CASE CAST(floor(o_totalprice / 100000e0) AS INTEGER) WHEN 0 THEN 'Very Negative' WHEN 1 THEN 'Negative'
      WHEN 3 THEN 'Positive' WHEN 4 THEN 'Very Positive' END AS investor,
    o_totalprice * 100000e0 AS market_cap,
    CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice / 100000e0, 1) END AS dividend_yield,
    (c_acctbal * 100e0 + o_totalprice) / 25000e0 - 20e0 AS tr_3m,
    CASE WHEN c_acctbal > 0 THEN c_acctbal / 250e0 + 10e0 END AS vol_ann,
    NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS matched,
    CASE WHEN c_nationkey < 10 THEN 'S&P 500' WHEN c_nationkey < 20 THEN 'S&P MidCap 400' END AS member,
    c_acctbal / 100e0 AS close_tr, o_totalprice * 500e0 AS adv_usd
  FROM st JOIN customer ON c_custkey = o_custkey
  WHERE rn = 1 AND as_of - CAST(o_orderdate AS DATE) <= 730),
panel AS (
  SELECT *, matched AND member IS NOT NULL AND close_tr >= 5 AND adv_usd >= 1e7 AS liquid FROM panel0),
liq AS (SELECT * FROM panel WHERE liquid)"""

VIEW = PANEL + f""",
med AS (SELECT as_of, {rnd("median(" + rnd("tr_3m", 1) + ")", 2)} AS median_tr_3m FROM liq GROUP BY as_of),
view0 AS (
  SELECT liq.as_of, ticker, sector, score, label, upside, best_upside, {rnd("tr_3m", 1)} AS tr_3m,
    {rnd("vol_ann", 1)} AS vol_ann,
    CASE WHEN target > 0 THEN {rnd("(best_target / target - 1e0) * 100e0", 1)} END AS bvc_gap,
    insider, investor, news, dividend_yield, {rnd("coalesce(market_cap, 0e0) / 1e9", 1)} AS mktcap_b,
    CASE WHEN member = 'S&P 500' THEN '500' ELSE '400' END AS idx, median_tr_3m
  FROM liq JOIN med ON med.as_of = liq.as_of),
pview AS (
  SELECT *, CASE WHEN vol_ann > 0 THEN {rnd("best_upside / vol_ann", 2)} END AS upside_per_vol,
    coalesce(tr_3m >= median_tr_3m, FALSE) AND insider IS DISTINCT FROM 'Negative'
      AND (score IS NULL OR score > 4) AS lens_pass
  FROM view0)"""

PAIRS = PANEL + f""",
pr0 AS (
  SELECT n.as_of, n.prev_as_of, n.capture_ord, n.ticker, n.sector, n.rating_date,
    p.label AS prev_cons, n.label AS now_cons, {rank("p.label")} AS rp, {rank("n.label")} AS rn,
    p.best_target AS bt_prev, n.best_target AS bt_now, p.target AS t_prev, n.target AS t_now,
    p.score AS ss_prev, n.score AS ss_now, p.insider AS ins_prev, n.insider AS ins_now,
    p.news AS news_prev, n.news AS news_now
  FROM liq n JOIN liq p ON p.ticker = n.ticker AND p.capture_ord = n.capture_ord - 1),
pr AS (
  SELECT *, CASE WHEN rp IS NULL OR rn IS NULL OR rp = rn THEN 0 WHEN rn < rp THEN 1 ELSE -1 END AS dir,
    rating_date BETWEEN prev_as_of AND as_of AS confirmed,
    CASE WHEN bt_now <> 0 AND abs(bt_now / nullif(bt_prev, 0) - 1e0) >= 0.0025e0
      THEN {rnd("(bt_now / bt_prev - 1e0) * 100e0", 2)} END AS bt_pct,
    CASE WHEN t_now <> 0 AND abs(t_now / nullif(t_prev, 0) - 1e0) >= 0.0025e0
      THEN {rnd("(t_now / t_prev - 1e0) * 100e0", 2)} END AS ct_pct,
    CASE WHEN ss_now <> ss_prev THEN ss_now - ss_prev END AS ss_d,
    ins_prev IS DISTINCT FROM ins_now AS ins_flip, news_prev IS DISTINCT FROM news_now AS news_flip
  FROM pr0),
em AS (
  SELECT *, (CASE WHEN confirmed THEN 5 ELSE 3 END) * dir
    + coalesce(CAST(sign(bt_pct) AS INTEGER) * CASE WHEN abs(bt_pct) < 1 THEN 2 WHEN abs(bt_pct) < 5 THEN 3 ELSE 4 END, 0)
    + coalesce(CAST(sign(ss_d) AS INTEGER), 0) AS rev_rank
  FROM pr WHERE dir <> 0 OR bt_pct IS NOT NULL OR ss_d IS NOT NULL OR ins_flip OR news_flip)"""

SYMBOL = "upper(replace(p_brand, '#', '-'))"
_BARS = """SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS session,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) AS DOUBLE) AS close,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
      / CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) AS DOUBLE) AS close_capital,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) AS DOUBLE) AS volume
  FROM {source} GROUP BY 1, 2"""
BARS = f"bars AS ({_BARS.format(symbol=SYMBOL, source='lineitem JOIN part ON p_partkey = l_partkey')})"
PART_BARS = f"pbars AS ({_BARS.format(symbol='l_partkey', source='lineitem')})"
MARKET = f"market AS ({_BARS.format(symbol=chr(39) + 'MARKET' + chr(39), source='lineitem')})"

EVENTS = """
cap AS (
  SELECT CAST(row_number() OVER (ORDER BY cap_ts) - 1 AS INTEGER) AS capture_ord, cap_ts,
         timezone('America/New_York', timezone('Asia/Singapore', cap_ts)) AS et
  FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)) + INTERVAL 1 DAY, max(ts), INTERVAL 31 HOUR)) AS cap_ts
        FROM events) q),
es AS (
  SELECT c.*, e.*, row_number() OVER (PARTITION BY c.capture_ord, e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM cap c JOIN events e ON e.ts <= c.cap_ts),
elog AS (
  SELECT capture_ord, cap_ts, et, user_id AS ticker,
    CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 END AS lab,
    100e0 + floor(value / 20e0) * 0.1e0 AS best_target,
    CASE WHEN value > 150 THEN CAST(ts AS DATE) - CAST(event_id % 4 AS INTEGER)
      ELSE DATE '2024-01-01' - CAST(user_id % 5 AS INTEGER) END AS rating_date, value
  FROM es WHERE rn = 1)"""
