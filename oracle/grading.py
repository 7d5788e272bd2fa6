"""Oracle SQL for the graded schemes, portfolios and inference."""

from __future__ import annotations

from oracle.base import PANEL, rank, rnd

SQL: dict[str, str] = {}

ROWS = PANEL + f""",
gp AS (SELECT p.*, p.vol_ann / 25e0 AS beta, (n1.target / p.target - 1e0) / 100e0 AS a1, (n2.target / p.target - 1e0) / 100e0 AS a2,
    (n3.target / p.target - 1e0) / 100e0 AS a3
  FROM panel p LEFT JOIN panel n1 ON n1.ticker = p.ticker AND n1.capture_ord = p.capture_ord + 1
  LEFT JOIN panel n2 ON n2.ticker = p.ticker AND n2.capture_ord = p.capture_ord + 2
  LEFT JOIN panel n3 ON n3.ticker = p.ticker AND n3.capture_ord = p.capture_ord + 3),
gr AS (SELECT g.*, CASE WHEN {rank('q.label')} IS NULL OR {rank('g.label')} IS NULL THEN 0
      ELSE CAST(sign({rank('q.label')} - {rank('g.label')}) AS INTEGER) END AS dir,
    q.ticker IS NOT NULL AND coalesce(g.rating_date BETWEEN g.prev_as_of AND g.as_of, FALSE) AS confirmed,
    CASE WHEN g.best_target <> 0 THEN {rnd('(g.best_target / nullif(q.best_target, 0) - 1e0) * 100e0', 6)} END AS target_pct
  FROM gp g LEFT JOIN liq q ON q.ticker = g.ticker AND q.capture_ord = g.capture_ord - 1 WHERE g.liquid),
s1a AS (SELECT * FROM gr WHERE dir > 0 AND confirmed),
s1b AS (SELECT * FROM gr WHERE target_pct > 0),
cls AS (SELECT as_of, score, coalesce(sum(count(*)) OVER (PARTITION BY as_of ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM gr WHERE score IS NOT NULL GROUP BY as_of, score),
s1c AS (SELECT gr.* FROM gr JOIN cls ON cls.as_of = gr.as_of AND cls.score = gr.score WHERE above < 90),
s3 AS (SELECT s1a.* FROM s1a JOIN (SELECT as_of, median(tr_3m) AS mid FROM gr GROUP BY 1) m ON m.as_of = s1a.as_of
  WHERE tr_3m > mid AND insider IS DISTINCT FROM 'Negative')"""

ZS = ROWS + f""",
c0 AS (SELECT gr.*, CASE WHEN confirmed THEN CAST(dir AS DOUBLE) ELSE 0e0 END AS c1, coalesce(target_pct, 0e0) AS c2,
  CASE insider WHEN 'Positive' THEN 1e0 WHEN 'Negative' THEN -1e0 ELSE 0e0 END AS c3 FROM gr),
cq AS (SELECT as_of, quantile_cont(c1, [0.01, 0.99]) AS q1, quantile_cont(c2, [0.01, 0.99]) AS q2, quantile_cont(c3, [0.01, 0.99]) AS q3 FROM c0 GROUP BY 1),
cw AS (SELECT c0.*, greatest(least(c1, q1[2]), q1[1]) AS w1, greatest(least(c2, q2[2]), q2[1]) AS w2, greatest(least(c3, q3[2]), q3[1]) AS w3
  FROM c0 JOIN cq ON cq.as_of = c0.as_of),
zs AS (SELECT *, coalesce((w1 - avg(w1) OVER k) / nullif(stddev_samp(w1) OVER k, 0), 0) AS z1,
  coalesce((w2 - avg(w2) OVER k) / nullif(stddev_samp(w2) OVER k, 0), 0) AS z2,
  coalesce((w3 - avg(w3) OVER k) / nullif(stddev_samp(w3) OVER k, 0), 0) AS z3 FROM cw WINDOW k AS (PARTITION BY as_of))"""


def residual(src: str, y: str, tag: str) -> str:
    """Successive orthogonalisation after demeaning within (capture, sector)."""
    k = "PARTITION BY as_of, sec"
    c = "PARTITION BY as_of"
    div = lambda a, b: f"coalesce(sum({a}) OVER ({c}) / nullif(sum({b}) OVER ({c}), 0), 0)"
    return f"""{tag}0 AS (SELECT *, coalesce(sector, '—') AS sec, ln(market_cap) AS x1, coalesce(dividend_yield, 0e0) AS x2, beta AS x3 FROM {src} WHERE {y} IS NOT NULL AND beta IS NOT NULL),
{tag}1 AS (SELECT *, {y} - avg({y}) OVER ({k}) AS dy, x1 - avg(x1) OVER ({k}) AS d1, x2 - avg(x2) OVER ({k}) AS d2, x3 - avg(x3) OVER ({k}) AS d3 FROM {tag}0),
{tag}2 AS (SELECT *, d2 - d1 * {div('d1 * d2', 'd1 * d1')} AS e2 FROM {tag}1),
{tag}3 AS (SELECT *, d3 - d1 * {div('d1 * d3', 'd1 * d1')} - e2 * {div('e2 * d3', 'e2 * e2')} AS e3 FROM {tag}2),
{tag} AS (SELECT *, dy - d1 * {div('d1 * dy', 'd1 * d1')} - e2 * {div('e2 * dy', 'e2 * e2')} - e3 * {div('e3 * dy', 'e3 * e3')} AS res FROM {tag}3)"""


S2 = ZS + f""",
cmp AS (SELECT *, z1 + z2 + z3 AS comp FROM zs), {residual('cmp', 'comp', 'cr')},
cs AS (SELECT *, (rank() OVER (PARTITION BY as_of ORDER BY round(res, 9) DESC) - 1) / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE) AS share FROM cr),
s2 AS (SELECT * FROM cs WHERE share < 0.10e0)"""
ALL5 = S2 + """,
mem AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS scheme, as_of, capture_ord, ticker, sector, adv_usd, a1, a2, a3 FROM {t}"
    for n, t in [("S1a", "s1a"), ("S1b", "s1b"), ("S1c", "s1c"), ("S2", "s2"), ("S3", "s3")]
) + ")"

SQL["event_buckets"] = f"WITH {ROWS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS scheme, as_of, ticker FROM {t}" for n, t in [("S1a", "s1a"), ("S1b", "s1b"), ("S3", "s3")]
)
SQL["target_revision_rank"] = f"WITH {ROWS} SELECT as_of, ticker, target_pct, rank() OVER (PARTITION BY as_of ORDER BY target_pct DESC) AS place FROM s1b"
SQL["score_class_bucket"] = f"WITH {ROWS} SELECT as_of, ticker, score AS smart_score FROM s1c"
SQL["winsor_zscore"] = f"WITH {ZS} SELECT as_of, ticker, {rnd('z1', 6)} AS rating_z, {rnd('z2', 6)} AS target_z, {rnd('z3', 6)} AS insider_z FROM zs"
SQL["style_residual"] = f"WITH {ROWS}, {residual('gr', 'a2', 'ar')} SELECT as_of, ticker, {rnd('res', 6)} AS residual FROM ar"
SQL["composite_decile"] = f"WITH {S2} SELECT as_of, ticker, {rnd(rnd('res', 9), 6)} AS composite_residual FROM s2"
SQL["capped_top20"] = f"""WITH {ROWS},
t AS (SELECT *, row_number() OVER (PARTITION BY as_of, coalesce(sector, '—') ORDER BY best_upside DESC, ticker) AS k FROM gr),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY best_upside DESC, ticker) AS INTEGER) AS place FROM t WHERE k <= 5)
SELECT as_of, place, ticker, sector, best_upside FROM u WHERE place <= 20"""

BOOK = ROWS + """,
bm AS (SELECT 'S1a' AS scheme, capture_ord, ticker, adv_usd FROM s1a UNION ALL SELECT 'S1c', capture_ord, ticker, adv_usd FROM s1c),
bn AS (SELECT scheme, capture_ord, count(*) AS n FROM bm GROUP BY 1, 2),
bk AS (SELECT bm.scheme, CAST(bm.capture_ord + d.i AS INTEGER) AS book_ord, ticker, sum(1e0 / (n * 4)) AS weight, count(*) AS cohorts, max_by(adv_usd, bm.capture_ord) AS adv_usd
  FROM bm JOIN bn ON bn.scheme = bm.scheme AND bn.capture_ord = bm.capture_ord CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) d
  WHERE bm.capture_ord + d.i <= (SELECT max(capture_ord) FROM caps) GROUP BY 1, 2, 3)"""
SQL["cohort_weights"] = f"WITH {BOOK} SELECT scheme, book_ord, ticker, {rnd('weight', 9)} AS weight, cohorts FROM bk"
TRADES = BOOK + """,
td AS (SELECT a.scheme, a.ticker, a.book_ord, a.weight - coalesce(p.weight, 0) AS ch, a.adv_usd FROM bk a
    LEFT JOIN bk p ON p.scheme = a.scheme AND p.ticker = a.ticker AND p.book_ord = a.book_ord - 1
  UNION ALL SELECT a.scheme, a.ticker, a.book_ord + 1, -a.weight, a.adv_usd FROM bk a LEFT JOIN bk n ON n.scheme = a.scheme AND n.ticker = a.ticker
    AND n.book_ord = a.book_ord + 1 WHERE n.ticker IS NULL AND a.book_ord < (SELECT max(capture_ord) FROM caps)),
tt AS (SELECT *, CASE WHEN adv_usd >= 1e8 THEN 3e0 WHEN adv_usd >= 25e6 THEN 8e0 ELSE 15e0 END AS bps FROM td WHERE abs(ch) > 1e-12)"""
SQL["tiered_costs"] = f"""WITH {TRADES}
SELECT scheme, book_ord, count(*) AS n_trades, {rnd('sum(abs(ch)) / 2', 6)} AS turnover, {rnd('sum(abs(ch) * bps)', 6)} AS tiered_bps,
  {rnd('sum(abs(ch) * 0)', 6)} AS flat_0_bps, {rnd('sum(abs(ch) * 5)', 6)} AS flat_5_bps, {rnd('sum(abs(ch) * 10)', 6)} AS flat_10_bps,
  {rnd('sum(abs(ch) * 20)', 6)} AS flat_20_bps FROM tt GROUP BY 1, 2"""
SQL["book_performance"] = f"""WITH {BOOK}
SELECT bk.scheme, book_ord, {rnd('sum(weight * a2) / sum(weight)', 7)} AS mean, {rnd('avg(CASE WHEN a2 > 0 THEN 1e0 ELSE 0e0 END)', 6)} AS hit_rate, count(*) AS names
FROM bk JOIN gr ON gr.ticker = bk.ticker AND gr.capture_ord = bk.book_ord WHERE a2 IS NOT NULL GROUP BY 1, 2"""
SQL["retention_band"] = f"""WITH RECURSIVE {ROWS},
rk AS (SELECT ticker, capture_ord, (rank() OVER (PARTITION BY as_of ORDER BY best_upside DESC) - 1) / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE) AS share FROM gr),
wk AS (SELECT ticker, capture_ord, share, share < 0.1e0 AS held FROM rk r WHERE NOT EXISTS
    (SELECT 1 FROM rk p WHERE p.ticker = r.ticker AND p.capture_ord = r.capture_ord - 4)
  UNION ALL SELECT r.ticker, r.capture_ord, r.share, CASE WHEN r.share >= 0.2e0 THEN FALSE ELSE wk.held OR r.share < 0.1e0 END
    FROM wk JOIN rk r ON r.ticker = wk.ticker AND r.capture_ord = wk.capture_ord + 4)
SELECT ticker, capture_ord, {rnd('share', 9)} AS rank_share, held FROM wk"""

_EST = """est AS (SELECT scheme, '1w' AS horizon, count(a1) AS n, avg(a1) AS mean, avg(CASE WHEN a1 > 0 THEN 1e0 WHEN a1 <= 0 THEN 0e0 END) AS hit FROM mem GROUP BY 1
  UNION ALL SELECT scheme, '1m', count(a2), avg(a2), avg(CASE WHEN a2 > 0 THEN 1e0 WHEN a2 <= 0 THEN 0e0 END) FROM mem GROUP BY 1
  UNION ALL SELECT scheme, '3m', count(a3), avg(a3), avg(CASE WHEN a3 > 0 THEN 1e0 WHEN a3 <= 0 THEN 0e0 END) FROM mem GROUP BY 1)"""
SQL["scheme_estimates"] = f"WITH {ALL5}, {_EST} SELECT scheme, horizon, n, {rnd('mean', 7)} AS mean, {rnd('hit', 6)} AS hit_rate FROM est WHERE n > 0"
_SIGN = """sg AS (SELECT scheme, max(mean) FILTER (horizon = '1m') AS m1, max(mean) FILTER (horizon = '1w') AS mw, max(mean) FILTER (horizon = '3m') AS m3 FROM est GROUP BY 1)"""
SQL["sign_stability"] = f"""WITH {ALL5}, {_EST}, {_SIGN} SELECT scheme, {rnd('m1', 7)} AS mean_1m, {rnd('mw', 7)} AS mean_1w, {rnd('m3', 7)} AS mean_3m,
  coalesce(sign(mw) = sign(m1) AND sign(m3) = sign(m1), FALSE) AS sign_stable FROM sg"""

_BLOCK = """bl0 AS (SELECT scheme, CAST(floor((capture_ord - 1) / 4e0) AS INTEGER) AS block, sum(a2) AS total, count(*) AS n FROM mem WHERE a2 IS NOT NULL GROUP BY 1, 2),
bl AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY scheme) AS nb FROM bl0),
bd AS (SELECT s.scheme, r.rep, CAST('0x' || substr(md5('7-' || s.scheme || '-' || r.rep || '-' || k.k), 1, 15) AS BIGINT) % s.nb AS idx
  FROM (SELECT DISTINCT scheme, nb FROM bl) s CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS rep) r CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS k) k WHERE k.k < s.nb),
bm2 AS (SELECT bd.scheme, bd.rep, sum(total) / sum(n) AS m FROM bd JOIN bl ON bl.scheme = bd.scheme AND bl.idx = bd.idx GROUP BY 1, 2),
ci AS (SELECT a.scheme, a.mean, a.n_blocks, lo, hi FROM (SELECT scheme, sum(total) / sum(n) AS mean, max(nb) AS n_blocks FROM bl GROUP BY 1) a
  JOIN (SELECT scheme, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm2 GROUP BY 1) e ON e.scheme = a.scheme)"""
SQL["block_bootstrap_ci"] = f"""WITH {ALL5}, {_BLOCK} SELECT scheme, {rnd('mean', 7)} AS mean, n_blocks, {rnd('lo', 7)} AS ci_low, {rnd('hi', 7)} AS ci_high,
  lo > 0 OR hi < 0 AS excludes_zero FROM ci"""

_NULL = """po AS (SELECT as_of, ticker, beta, a2 FROM gr WHERE beta IS NOT NULL AND a2 IS NOT NULL),
bi AS (SELECT *, CAST(floor((rank() OVER (PARTITION BY as_of ORDER BY beta) - 1) * 5 / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE)) AS INTEGER) AS bin FROM po),
nu AS (SELECT *, row_number() OVER (PARTITION BY as_of, bin ORDER BY md5(CAST(ticker AS VARCHAR))) - 1 AS idx, count(*) OVER (PARTITION BY as_of, bin) AS gn FROM bi),
pk AS (SELECT m.scheme, nu.* FROM mem m JOIN nu ON nu.as_of = m.as_of AND nu.ticker = m.ticker),
wt AS (SELECT scheme, as_of, bin, count(*) AS k, max(gn) AS gn FROM pk GROUP BY 1, 2, 3),
dr AS (SELECT wt.*, r.rep, unnest(generate_series(1, wt.k)) AS j FROM wt CROSS JOIN (SELECT unnest(generate_series(0, 98)) AS rep) r),
dx AS (SELECT *, CAST('0x' || substr(md5('11-' || scheme || '-' || CAST(as_of AS VARCHAR) || '-' || bin || '-' || rep || '-' || j), 1, 15) AS BIGINT) % gn AS idx FROM dr),
nm AS (SELECT dx.scheme, dx.rep, avg(a2) AS m FROM dx JOIN nu ON nu.as_of = dx.as_of AND nu.bin = dx.bin AND nu.idx = dx.idx GROUP BY 1, 2),
nl AS (SELECT a.scheme, a.actual, a.entries, count(*) AS reps, avg(m) AS null_mean, (count(*) FILTER (m >= actual) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value
  FROM nm JOIN (SELECT scheme, avg(a2) AS actual, count(*) AS entries FROM pk GROUP BY 1) a ON a.scheme = nm.scheme GROUP BY 1, 2, 3)"""
SQL["random_entry_null"] = f"WITH {ALL5}, {_NULL} SELECT scheme, {rnd('actual', 7)} AS actual, entries, reps, {rnd('null_mean', 7)} AS null_mean, {rnd('p_value', 6)} AS p_value FROM nl"
_BH = """bh0 AS (SELECT scheme, p_value, CAST(row_number() OVER (ORDER BY p_value, scheme) AS INTEGER) AS p_rank, 5 AS m FROM nl),
bh AS (SELECT *, p_rank * 0.1e0 / m AS threshold FROM bh0),
fd AS (SELECT *, coalesce(p_rank <= (SELECT max(p_rank) FROM bh WHERE p_value <= threshold), FALSE) AS keep FROM bh)"""
SQL["bh_fdr"] = f"WITH {ALL5}, {_NULL}, {_BH} SELECT scheme, {rnd('p_value', 6)} AS p_value, p_rank, {rnd('threshold', 6)} AS threshold, keep FROM fd"

_SERIES = "se AS (SELECT scheme, capture_ord, as_of, avg(a2) AS r FROM mem WHERE a2 IS NOT NULL GROUP BY 1, 2, 3)"


def cdf(z: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({z}) / sqrt(2e0)))"
    poly = f"(0.254829592e0 * {t} - 0.284496736e0 * {t} ** 2 + 1.421413741e0 * {t} ** 3 - 1.453152027e0 * {t} ** 4 + 1.061405429e0 * {t} ** 5)"
    tail = f"({poly} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


# expected maximum of five standard normals as used by the deflated Sharpe ratio
_PEAK = "(0.42278433509846713e0 * 0.8416212335729143e0 + 0.5772156649015329e0 * 1.4496656592240218e0)"
_DSR = f"""dm AS (SELECT scheme, count(*) AS t, avg(r) AS mu, stddev_samp(r) AS sd, avg(r * r) AS m2 FROM se GROUP BY 1),
dk AS (SELECT se.scheme, avg((r - mu) ** 3) / power(avg((r - mu) ** 2), 1.5) AS skew, avg((r - mu) ** 4) / power(avg((r - mu) ** 2), 2) AS kurt
  FROM se JOIN dm ON dm.scheme = se.scheme GROUP BY 1),
d1 AS (SELECT dm.scheme, t, mu / sd AS sharpe, skew, kurt, stddev_samp(mu / sd) OVER () * {_PEAK} AS fl FROM dm JOIN dk ON dk.scheme = dm.scheme),
d2 AS (SELECT *, (sharpe - fl) * sqrt(t - 1e0) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM d1),
ds AS (SELECT *, {cdf('z')} AS dsr FROM d2)"""
SQL["deflated_sharpe"] = f"WITH {ALL5}, {_SERIES}, {_DSR} SELECT scheme, t, {rnd('sharpe', 6)} AS sharpe, {rnd('fl', 6)} AS sharpe_floor, {rnd('dsr', 5)} AS dsr FROM ds"
SQL["effective_trials"] = f"""WITH {ALL5}, {_SERIES},
rh AS (SELECT corr(a.r, b.r) AS rho FROM se a JOIN se b ON a.capture_ord = b.capture_ord AND a.scheme < b.scheme GROUP BY a.scheme, b.scheme)
SELECT {rnd('avg(rho)', 6)} AS mean_rho, (SELECT count(DISTINCT scheme) FROM se) AS n,
  {rnd('1 + ((SELECT count(DISTINCT scheme) FROM se) - 1) * (1 - avg(rho))', 6)} AS effective_n FROM rh"""
SQL["verdicts"] = f"""WITH {ALL5}, {_EST}, {_SIGN}, {_BLOCK}, {_NULL}, {_BH}, {_SERIES}, {_DSR},
v AS (SELECT ci.scheme, ci.mean, lo > 0 OR hi < 0 AS excludes_zero, fd.keep AS survives_null,
   coalesce(sign(mw) = sign(m1) AND sign(m3) = sign(m1), FALSE) AS sign_stable, ds.dsr, (SELECT count(*) FROM caps) >= 26 AS eligible
  FROM ci JOIN fd ON fd.scheme = ci.scheme JOIN sg ON sg.scheme = ci.scheme JOIN ds ON ds.scheme = ci.scheme)
SELECT scheme, {rnd('mean', 7)} AS mean, excludes_zero, survives_null, sign_stable, {rnd('dsr', 5)} AS dsr, eligible,
  excludes_zero AND survives_null AND sign_stable AS keep,
  coalesce(eligible AND excludes_zero AND survives_null AND sign_stable AND mean >= 0.0025 AND dsr >= 0.9, FALSE) AS graduates FROM v"""
SQL["quarterly_regrade"] = f"""WITH {ALL5}, {_SERIES}, cut AS (SELECT DISTINCT CAST(date_trunc('year', as_of) + INTERVAL 1 YEAR AS DATE) AS cutoff FROM caps)
SELECT scheme, cutoff, count(*) AS captures, {rnd('avg(r)', 7)} AS mean FROM se JOIN cut ON se.as_of <= cutoff GROUP BY 1, 2"""
SQL["paper_track"] = f"""WITH {ALL5}, {_SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY capture_ord) AS k FROM se)
SELECT scheme, count(*) AS captures, {rnd('avg(r)', 7)} AS net_alpha, count(*) = 13 AND avg(r) >= 0 AS passes FROM k WHERE k <= 13 GROUP BY 1"""
SQL["decile_diagnostics"] = f"""WITH {ROWS},
s AS (SELECT *, (rank() OVER (PARTITION BY as_of ORDER BY best_upside DESC) - 1) / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE) AS share FROM gr)
SELECT as_of, {rnd('avg(a2) FILTER (share < 0.1e0)', 7)} AS top_mean, {rnd('avg(a2) FILTER (share >= 0.9e0)', 7)} AS bottom_mean,
  {rnd('avg(a2) FILTER (share < 0.1e0) - avg(a2) FILTER (share >= 0.9e0)', 7)} AS spread, {rnd('avg(a2)', 7)} AS universe_mean
FROM s WHERE a2 IS NOT NULL GROUP BY 1"""
SQL["score_risers"] = f"""WITH {ROWS}
SELECT CAST(sign(g.score - p.score) AS INTEGER) AS score_move, count(*) AS names, {rnd('avg(g.a2)', 7)} AS mean
FROM gr g JOIN gr p ON p.ticker = g.ticker AND p.capture_ord = g.capture_ord - 1 WHERE g.a2 IS NOT NULL AND g.score - p.score IS NOT NULL GROUP BY 1"""
SQL["axis_attribution"] = f"""WITH {ROWS},
l AS (SELECT as_of, a2, 'analyst' AS axis, CASE WHEN {rank('label')} <= 1 THEN 1 WHEN {rank('label')} >= 3 THEN -1 WHEN label IS NOT NULL THEN 0 END AS side FROM gr
  UNION ALL SELECT as_of, a2, 'insider', CASE insider WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 END FROM gr
  UNION ALL SELECT as_of, a2, 'news', CASE news WHEN 'Bullish' THEN 1 WHEN 'Bearish' THEN -1 ELSE 0 END FROM gr)
SELECT as_of, axis, {rnd('avg(a2) FILTER (side > 0)', 7)} AS positive_mean, {rnd('avg(a2) FILTER (side < 0)', 7)} AS negative_mean, count(*) AS names
FROM l WHERE a2 IS NOT NULL AND side IS NOT NULL GROUP BY 1, 2"""

SQL["book_net_alpha"] = f"""WITH {TRADES},
g AS (SELECT bk.scheme, book_ord, sum(weight * a2) / sum(weight) AS gross FROM bk JOIN gr ON gr.ticker = bk.ticker AND gr.capture_ord = bk.book_ord
  WHERE a2 IS NOT NULL GROUP BY 1, 2),
c AS (SELECT scheme, book_ord, sum(abs(ch) * bps) AS cost FROM tt GROUP BY 1, 2)
SELECT g.scheme, g.book_ord, {rnd('gross', 7)} AS gross, {rnd('coalesce(cost, 0)', 6)} AS cost_bps, {rnd('gross - coalesce(cost, 0) / 1e4', 7)} AS net
FROM g LEFT JOIN c ON c.scheme = g.scheme AND c.book_ord = g.book_ord"""

# the books of all five schemes, and cut-offs at quarter ends
BOOKS = ALL5 + """,
bm AS (SELECT scheme, capture_ord, ticker, adv_usd FROM mem)""" + BOOK[BOOK.index(",\nbn AS"):]
for _name in ("cohort_weights", "tiered_costs", "book_performance", "book_net_alpha"):
    SQL[f"{_name}_all"] = SQL[_name].replace(BOOK, BOOKS)
SQL["quarterly_regrade_all"] = f"""WITH {ALL5}, {_SERIES},
cut AS (SELECT DISTINCT CAST(date_trunc('quarter', as_of) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS cutoff FROM caps)
SELECT scheme, cutoff, count(*) AS captures, {rnd('avg(r)', 7)} AS mean FROM se JOIN cut ON se.as_of <= cutoff GROUP BY 1, 2"""
