"""Oracle SQL for the cross-section and revision families."""

from __future__ import annotations

from oracle.base import PAIRS, PANEL, VIEW, rnd

SQL: dict[str, str] = {}

SQL["revision_pair_counts"] = f"""WITH {PAIRS},
ent AS (SELECT n.as_of, count(*) AS entered_n FROM liq n WHERE prev_as_of IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM liq p WHERE p.ticker = n.ticker AND p.capture_ord = n.capture_ord - 1) GROUP BY 1),
lef AS (SELECT p.next_as_of AS as_of, count(*) AS left_n FROM liq p WHERE next_as_of IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM liq n WHERE p.ticker = n.ticker AND p.capture_ord = n.capture_ord - 1) GROUP BY 1),
agg AS (SELECT as_of, count(*) AS pairs, count(*) FILTER (dir > 0) AS upgrades, count(*) FILTER (dir < 0) AS downgrades,
  count(*) FILTER (dir > 0 AND confirmed) AS confirmed_up, count(*) FILTER (dir < 0 AND confirmed) AS confirmed_down,
  count(*) FILTER (bt_pct > 0) AS target_raises, count(*) FILTER (bt_pct <= 0) AS target_cuts,
  count(*) FILTER (bt_pct > 0 AND confirmed) AS target_raises_confirmed,
  count(*) FILTER (bt_pct <= 0 AND confirmed) AS target_cuts_confirmed,
  {rnd("median(bt_pct) FILTER (bt_pct > 0)", 2)} AS median_raise_pct,
  {rnd("median(bt_pct) FILTER (bt_pct <= 0)", 2)} AS median_cut_pct FROM pr GROUP BY 1),
win AS (SELECT prev_as_of, as_of FROM caps WHERE prev_as_of IS NOT NULL)
SELECT win.prev_as_of, win.as_of, coalesce(pairs, 0) AS pairs, coalesce(upgrades, 0) AS upgrades,
  coalesce(downgrades, 0) AS downgrades, coalesce(confirmed_up, 0) AS confirmed_up,
  coalesce(confirmed_down, 0) AS confirmed_down, coalesce(target_raises, 0) AS target_raises,
  coalesce(target_cuts, 0) AS target_cuts, coalesce(target_raises_confirmed, 0) AS target_raises_confirmed,
  coalesce(target_cuts_confirmed, 0) AS target_cuts_confirmed, median_raise_pct, median_cut_pct,
  coalesce(entered_n, 0) AS entered_n, coalesce(left_n, 0) AS left_n,
  CAST(win.as_of - win.prev_as_of AS INTEGER) AS window_days
FROM win LEFT JOIN agg USING (as_of) LEFT JOIN ent USING (as_of) LEFT JOIN lef USING (as_of)"""

SQL["revision_rows_scored"] = f"""WITH {PAIRS}
SELECT as_of, prev_as_of, ticker, sector, prev_cons, now_cons, dir, confirmed, rating_date, bt_prev, bt_now, bt_pct, ct_pct,
  ss_prev, ss_now, ss_d, CASE WHEN ins_flip THEN ins_prev END AS ins_prev, CASE WHEN ins_flip THEN ins_now END AS ins_now,
  CASE WHEN news_flip THEN news_prev END AS news_prev, CASE WHEN news_flip THEN news_now END AS news_now, rev_rank,
  CASE WHEN rev_rank > 0 THEN 'up' WHEN rev_rank < 0 THEN 'down' END AS rev_badge,
  concat_ws(' · ',
    CASE WHEN dir <> 0 THEN prev_cons || ' → ' || now_cons
      || CASE WHEN confirmed THEN ' (confirmed in window)' ELSE ' (no rating date in window)' END END,
    'best target ' || CASE WHEN bt_pct >= 0 THEN '+' ELSE '' END || CAST(bt_pct AS VARCHAR) || '%',
    'Smart Score ' || CASE WHEN ss_d >= 0 THEN '+' ELSE '' END || CAST(CAST(ss_d AS INTEGER) AS VARCHAR),
    CASE WHEN ins_flip THEN 'insider ' || coalesce(ins_prev, '—') || ' → ' || coalesce(ins_now, '—') END,
    CASE WHEN news_flip THEN 'news ' || coalesce(news_prev, '—') || ' → ' || coalesce(news_now, '—') END) AS rev_note
FROM em"""

SQL["revision_view_counts"] = f"""WITH {PAIRS}
SELECT as_of, count(*) AS emitted_rows, count(*) FILTER (ss_d > 0) AS score_up, count(*) FILTER (ss_d < 0) AS score_down
FROM em GROUP BY 1"""

_BREADTH = """SELECT as_of, coalesce(sector, '—') AS sector, {n}
  count(*) FILTER (dir > 0) - count(*) FILTER (dir < 0) AS net_upgrades,
  count(*) FILTER (bt_pct > 0) AS raises, count(*) FILTER (bt_pct < 0) AS cuts FROM pr GROUP BY 1, 2 {having}"""
SQL["revision_sector_breadth_all"] = f"WITH {PAIRS} " + _BREADTH.format(n="", having="")
SQL["revision_sector_breadth_emitted"] = f"WITH {PAIRS} " + _BREADTH.format(
    n="count(*) AS n,",
    having="HAVING count(*) FILTER (dir <> 0 OR bt_pct IS NOT NULL OR ss_d IS NOT NULL OR ins_flip OR news_flip) > 0",
)

SQL["revision_entered"] = f"""WITH {PANEL}
SELECT as_of, ticker FROM liq n WHERE prev_as_of IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM liq p WHERE p.ticker = n.ticker AND p.capture_ord = n.capture_ord - 1)"""

SQL["revision_left_reason"] = f"""WITH {PANEL}
SELECT p.next_as_of AS as_of, p.ticker, CASE WHEN n.ticker IS NULL THEN 'absent from this week''s export'
  WHEN NOT n.matched THEN 'unmatched on the feed' ELSE 'lost index membership or liquidity floor' END AS reason
FROM liq p LEFT JOIN panel n ON n.ticker = p.ticker AND n.capture_ord = p.capture_ord + 1
WHERE p.next_as_of IS NOT NULL AND NOT coalesce(n.liquid, FALSE)"""

_WEEK = f"""SELECT as_of, count(*) AS liquid,
  {rnd("100e0 * count(*) FILTER (label IN ('Strong Buy', 'Moderate Buy')) / count(*)", 1)} AS pct_buy,
  {rnd("median(upside)", 2)} AS median_upside, {rnd("median(best_upside)", 2)} AS median_best_upside,
  {rnd("median(score)", 2)} AS median_smart_score FROM liq GROUP BY 1"""
SQL["week_aggregates"] = f"WITH {PANEL} {_WEEK}"
SQL["weekly_series"] = f"""WITH {PAIRS}, wk AS ({_WEEK}),
mv AS (SELECT as_of, count(*) FILTER (dir > 0) AS upgrades, count(*) FILTER (dir < 0) AS downgrades,
  count(*) FILTER (bt_pct > 0) AS target_raises, count(*) FILTER (bt_pct <= 0) AS target_cuts FROM pr GROUP BY 1)
SELECT wk.*, CASE WHEN c.prev_as_of IS NOT NULL THEN coalesce(upgrades, 0) END AS upgrades,
  CASE WHEN c.prev_as_of IS NOT NULL THEN coalesce(downgrades, 0) END AS downgrades,
  CASE WHEN c.prev_as_of IS NOT NULL THEN coalesce(target_raises, 0) END AS target_raises,
  CASE WHEN c.prev_as_of IS NOT NULL THEN coalesce(target_cuts, 0) END AS target_cuts
FROM wk JOIN caps c ON c.as_of = wk.as_of LEFT JOIN mv ON mv.as_of = wk.as_of"""

SQL["consensus_mix"] = f"""WITH {PANEL},
d AS (SELECT unnest(['Strong Buy', 'Moderate Buy', 'Hold', 'Moderate Sell', 'Strong Sell']) AS label),
k AS (SELECT DISTINCT as_of FROM liq)
SELECT k.as_of, d.label, count(liq.ticker) AS n FROM k CROSS JOIN d
LEFT JOIN liq ON liq.as_of = k.as_of AND liq.label = d.label GROUP BY 1, 2"""

SQL["score_histogram"] = f"""WITH {PANEL}, d AS (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS bucket),
k AS (SELECT DISTINCT as_of FROM liq)
SELECT k.as_of, d.bucket, count(liq.ticker) AS n FROM k CROSS JOIN d
LEFT JOIN liq ON liq.as_of = k.as_of AND round_even(liq.score, 0) = d.bucket GROUP BY 1, 2"""

SQL["sector_summary"] = f"""WITH {PANEL}
SELECT as_of, coalesce(sector, '—') AS sector, count(*) AS n, {rnd("avg(score)", 2)} AS mean_ss,
  {rnd("100e0 * count(*) FILTER (label IN ('Strong Buy', 'Moderate Buy')) / count(*)", 1)} AS pct_buy
FROM liq GROUP BY 1, 2"""

SQL["flow_tally"] = f"""WITH {PANEL}
SELECT as_of, 'insider' AS axis, insider AS category, count(*) AS n FROM liq WHERE insider IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT as_of, 'investor', investor, count(*) FROM liq WHERE investor IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT as_of, 'news', news, count(*) FROM liq GROUP BY 1, 3"""

_AX = """SELECT as_of, '{f}' AS axis, count(*) FILTER ({c} ILIKE '%positive%' OR {c} ILIKE '%bullish%') AS positive,
  count(*) FILTER ({c} ILIKE '%negative%' OR {c} ILIKE '%bearish%') AS negative,
  count(*) FILTER ({c} IS NULL OR {c} = 'Neutral') AS neutral FROM liq GROUP BY 1"""
SQL["stance_counts"] = f"WITH {PANEL} " + " UNION ALL ".join(
    _AX.format(f=f, c=c)
    for f, c in [("insider_signal", "insider"), ("investor_sentiment", "investor"), ("news_sentiment", "news")]
)

SQL["index_counts"] = f"""WITH {PANEL}
SELECT as_of, count(*) AS snapshot_total, count(*) FILTER (matched) AS matched, count(*) FILTER (liquid) AS liquid,
  count(*) FILTER (liquid AND member = 'S&P 500') AS sp500, count(*) FILTER (liquid AND member = 'S&P MidCap 400') AS sp400
FROM panel GROUP BY 1"""

SQL["accrual"] = f"""WITH {PANEL}
SELECT count(*) AS snapshots, min(as_of) AS first_as_of, max(as_of) AS last_as_of,
  count(*) FILTER (DATE '2001-01-15' - as_of >= 31) AS matured, greatest(0, 8 - count(*)) AS remaining,
  count(*) >= 8 AS runnable FROM caps"""

SQL["panel_view"] = f"""WITH {VIEW}
SELECT as_of, ticker, sector, score AS smart_score, label AS analyst_consensus, upside, best_upside, tr_3m, vol_ann, bvc_gap,
  insider AS insider_signal, investor AS investor_sentiment, news AS news_sentiment, dividend_yield, mktcap_b, idx,
  median_tr_3m, upside_per_vol, lens_pass FROM pview"""

SQL["lens_flags"] = f"""WITH {VIEW}
SELECT as_of, count(*) AS "rows", first(median_tr_3m) AS median_tr_3m, count(*) FILTER (lens_pass) AS n_pass
FROM pview GROUP BY 1"""

SQL["sector_percent_rank"] = f"""WITH {VIEW},
v AS (SELECT as_of, ticker, coalesce(sector, '—') AS sector, upside_per_vol FROM pview),
r AS (SELECT *, rank() OVER (PARTITION BY as_of, sector ORDER BY upside_per_vol) - 1 AS below,
  count(*) OVER (PARTITION BY as_of, sector) AS n FROM v WHERE upside_per_vol IS NOT NULL)
SELECT v.as_of, v.sector, v.ticker, v.upside_per_vol,
  CASE WHEN n >= 2 THEN CAST(round_even(100e0 * below / (n - 1), 0) AS INTEGER) END AS sector_pct
FROM v LEFT JOIN r USING (as_of, ticker)"""

SQL["sector_leaders"] = f"""WITH {VIEW},
v AS (SELECT as_of, ticker, coalesce(sector, '—') AS sector, upside_per_vol FROM pview WHERE upside_per_vol IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of, sector ORDER BY upside_per_vol DESC, ticker) AS INTEGER) AS place FROM v)
SELECT as_of, sector, place, ticker, upside_per_vol FROM r WHERE place <= 3"""

for _name, _k in (("latest_capture", 1), ("previous_capture", 2)):
    SQL[_name] = f"""WITH {PANEL}, k AS (SELECT as_of, dense_rank() OVER (ORDER BY as_of DESC) AS k FROM (SELECT DISTINCT as_of FROM panel) q)
SELECT panel.as_of, ticker, liquid FROM panel JOIN k ON k.as_of = panel.as_of WHERE k = {_k}"""
SQL["revision_with_lens"] = f"""WITH {PAIRS} {VIEW[len(PANEL):]}
SELECT em.as_of, em.ticker, rev_rank, lens_pass, upside_per_vol FROM em LEFT JOIN pview ON pview.as_of = em.as_of AND pview.ticker = em.ticker"""
