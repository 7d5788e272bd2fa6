"""Oracle SQL for grading on realised returns."""

from __future__ import annotations

from oracle.base import BARS, MARKET, PANEL, rnd
from oracle.grading import BOOK, ROWS, ZS, _PEAK, cdf, residual
from oracle.returns import RISK, fwd

SQL: dict[str, str] = {}

# the panel's alphas and betas from realised returns in place of the stand-ins of the other grading queries
ALPHA = f"""{BARS}, {MARKET}, {RISK}, {fwd('bars', "['1w', '1m', '3m']")},
ad AS (SELECT fr.symbol, fr.as_of, fr.horizon, ret_frac - beta * (m2.close / m1.close - 1e0)
    - drift * (SELECT count(*) FROM market m WHERE m.session > fr.entry_date AND m.session <= fr.exit_date) AS alpha
  FROM fr JOIN risk ON risk.symbol = fr.symbol AND risk.as_of = fr.as_of LEFT JOIN market m1 ON m1.session = fr.entry_date
  LEFT JOIN market m2 ON m2.session = fr.exit_date WHERE ret_frac IS NOT NULL),
al AS (SELECT symbol, as_of, max(alpha) FILTER (horizon = '1w') AS a1, max(alpha) FILTER (horizon = '1m') AS a2,
  max(alpha) FILTER (horizon = '3m') AS a3 FROM ad GROUP BY 1, 2)"""
_GR = ROWS[ROWS.index(",\ngr AS"):]
PRICED = PANEL + f""", {ALPHA},
gp AS (SELECT p.*, risk.beta, risk.drift, al.a1, al.a2, al.a3 FROM panel p
  LEFT JOIN risk ON risk.symbol = 'BRAND-' || (1 + p.ticker % 25) AND risk.as_of = p.as_of
  LEFT JOIN al ON al.symbol = risk.symbol AND al.as_of = p.as_of){_GR}"""
_ZS = ZS[len(ROWS):]

MEMBERS = PRICED + f"""{_ZS},
{residual('gr', 'a1', 'ua')}, {residual('gr', 'a2', 'ub')}, {residual('gr', 'a3', 'uc')},
gn AS (SELECT gr.*, ua.res AS r1, ub.res AS r2, uc.res AS r3 FROM gr LEFT JOIN ua ON ua.as_of = gr.as_of AND ua.ticker = gr.ticker
  LEFT JOIN ub ON ub.as_of = gr.as_of AND ub.ticker = gr.ticker LEFT JOIN uc ON uc.as_of = gr.as_of AND uc.ticker = gr.ticker),
cmp AS (SELECT *, z1 + z2 + z3 AS comp FROM zs), {residual('cmp', 'comp', 'cr')},
cs AS (SELECT *, (rank() OVER (PARTITION BY as_of ORDER BY round(res, 9) DESC) - 1) / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE) AS share FROM cr),
band AS (SELECT 'S2' AS scheme, ticker, capture_ord, share < 0.1e0 AS enters FROM cs WHERE share < 0.2e0
  UNION ALL SELECT 'S1c', gr.ticker, gr.capture_ord, above < 90 FROM gr JOIN cls ON cls.as_of = gr.as_of AND cls.score = gr.score WHERE above < 180),
wk AS (SELECT scheme, ticker, capture_ord, enters AS held FROM band b WHERE NOT EXISTS
    (SELECT 1 FROM band p WHERE p.scheme = b.scheme AND p.ticker = b.ticker AND p.capture_ord = b.capture_ord - 4)
  UNION ALL SELECT b.scheme, b.ticker, b.capture_ord, wk.held OR b.enters FROM wk JOIN band b
    ON b.scheme = wk.scheme AND b.ticker = wk.ticker AND b.capture_ord = wk.capture_ord + 4),
pick AS (SELECT scheme, ticker, capture_ord FROM wk WHERE held UNION ALL SELECT 'S1a', ticker, capture_ord FROM s1a
  UNION ALL SELECT 'S1b', ticker, capture_ord FROM s1b UNION ALL SELECT 'S3', ticker, capture_ord FROM s3),
mem AS (SELECT pick.scheme, gn.* FROM pick JOIN gn ON gn.ticker = pick.ticker AND gn.capture_ord = pick.capture_ord
  WHERE as_of > (SELECT min(as_of) FROM caps))"""

COSTS = MEMBERS + """,
bm AS (SELECT scheme, capture_ord, ticker, adv_usd FROM mem)""" + BOOK[BOOK.index(",\nbn AS"):] + """,
td AS (SELECT a.scheme, a.ticker, a.book_ord, a.weight - coalesce(p.weight, 0) AS ch FROM bk a
    LEFT JOIN bk p ON p.scheme = a.scheme AND p.ticker = a.ticker AND p.book_ord = a.book_ord - 1
  UNION ALL SELECT a.scheme, a.ticker, a.book_ord + 1, -a.weight FROM bk a LEFT JOIN bk n ON n.scheme = a.scheme AND n.ticker = a.ticker
    AND n.book_ord = a.book_ord + 1 WHERE n.ticker IS NULL AND a.book_ord < (SELECT max(capture_ord) FROM caps)),
tt AS (SELECT td.*, CASE WHEN gr.adv_usd >= 1e8 THEN 3e0 WHEN gr.adv_usd >= 25e6 THEN 8e0 ELSE 15e0 END AS bps FROM td
  LEFT JOIN gr ON gr.ticker = td.ticker AND gr.capture_ord = td.book_ord WHERE abs(ch) > 1e-12)"""
NET = COSTS + """,
ct AS (SELECT scheme, book_ord, sum(abs(ch) * bps) * 4 AS bps FROM tt GROUP BY 1, 2),
ne AS (SELECT g.*, coalesce(ct.bps, 0) AS cost, gross - coalesce(ct.bps, 0) / 1e4 AS net FROM
  (SELECT scheme, capture_ord, as_of, count(r2) AS names, avg(r2) AS gross, avg(r1) AS gross_1w, avg(r3) AS gross_3m FROM mem GROUP BY 1, 2, 3) g
  LEFT JOIN ct ON ct.scheme = g.scheme AND ct.book_ord = g.capture_ord)"""

SQL["graded_returns"] = f"""WITH {PANEL}, {ALPHA}
SELECT risk.symbol, risk.as_of, {rnd('beta', 6)} AS beta, {rnd('drift', 6)} AS drift_per_session, {rnd('a1', 5)} AS alpha_1w, {rnd('a2', 5)} AS alpha_1m,
  {rnd('a3', 5)} AS alpha_3m FROM risk LEFT JOIN al ON al.symbol = risk.symbol AND al.as_of = risk.as_of"""
SQL["retained_book_costs"] = f"""WITH RECURSIVE {COSTS}
SELECT scheme, book_ord, count(*) AS n_trades, {rnd('sum(abs(ch)) / 2', 6)} AS turnover, {rnd('sum(abs(ch) * bps)', 6)} AS tiered_bps,
  {rnd('sum(abs(ch) * 0)', 6)} AS flat_0_bps, {rnd('sum(abs(ch) * 5)', 6)} AS flat_5_bps, {rnd('sum(abs(ch) * 10)', 6)} AS flat_10_bps,
  {rnd('sum(abs(ch) * 20)', 6)} AS flat_20_bps FROM tt GROUP BY 1, 2"""
SQL["retained_top20"] = f"""WITH RECURSIVE {PRICED},
t AS (SELECT *, row_number() OVER (PARTITION BY as_of, coalesce(sector, '—') ORDER BY best_upside DESC, ticker) AS k FROM gr),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY best_upside DESC, ticker) AS INTEGER) AS place FROM t WHERE k <= 5),
v AS (SELECT *, place <= 20 AS enters FROM u WHERE place <= 40),
wk AS (SELECT ticker, capture_ord, enters AS held FROM v b WHERE NOT EXISTS (SELECT 1 FROM v p WHERE p.ticker = b.ticker AND p.capture_ord = b.capture_ord - 4)
  UNION ALL SELECT b.ticker, b.capture_ord, wk.held OR b.enters FROM wk JOIN v b ON b.ticker = wk.ticker AND b.capture_ord = wk.capture_ord + 4)
SELECT v.as_of, v.ticker, v.place, v.sector FROM v JOIN wk ON wk.ticker = v.ticker AND wk.capture_ord = v.capture_ord WHERE held"""
SQL["graded_net_alpha"] = f"""WITH RECURSIVE {NET}
SELECT scheme, capture_ord, as_of, names, {rnd('gross', 7)} AS gross, {rnd('gross_1w', 7)} AS gross_1w, {rnd('gross_3m', 7)} AS gross_3m,
  {rnd('cost', 6)} AS cost_bps, {rnd('net', 7)} AS net FROM ne"""

CUTS = "cut AS (SELECT DISTINCT CAST(date_trunc('quarter', as_of) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS cutoff FROM caps)"
LAST = "cut AS (SELECT max(CAST(date_trunc('quarter', as_of) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS cutoff FROM caps)"
# a quantile of the Poisson distribution with mean 1 in units of 2 ** -32
_STEPS = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276]
_TIMES = " + ".join(f"CAST(u >= {x} AS INTEGER)" for x in _STEPS)
BOOT = f"""kn AS (SELECT *, CAST(floor((capture_ord - 1) / 4e0) AS INTEGER) AS block, CAST(as_of + INTERVAL 1 MONTH AS DATE) AS known_on FROM ne WHERE net IS NOT NULL),
pw AS (SELECT block, rep, {_TIMES} AS w FROM (SELECT block, rep, CAST('0x' || substr(md5('7-' || block || '-' || rep), 1, 8) AS BIGINT) AS u
  FROM (SELECT DISTINCT block FROM kn), (SELECT unnest(range(0, 2000)) AS rep))),
rm AS (SELECT scheme, cutoff, rep, sum(net * w) / nullif(sum(w), 0) AS m FROM kn JOIN cut ON known_on <= cutoff JOIN pw ON pw.block = kn.block GROUP BY 1, 2, 3),
bt AS (SELECT a.*, lo AS ci_low, hi AS ci_high, coalesce(lo > 0 OR hi < 0, FALSE) AS excludes_zero FROM
  (SELECT scheme, cutoff, count(*) AS cohorts, count(DISTINCT block) AS blocks, avg(net) AS mean FROM kn JOIN cut ON known_on <= cutoff GROUP BY 1, 2) a
  LEFT JOIN (SELECT scheme, cutoff, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rm GROUP BY 1, 2) q ON q.scheme = a.scheme AND q.cutoff = a.cutoff)"""
SQL["block_bootstrap_net"] = f"""WITH RECURSIVE {NET}, {LAST}, {BOOT}
SELECT scheme, cutoff, cohorts, CAST(blocks AS INTEGER) AS blocks, {rnd('mean', 7)} AS mean, {rnd('ci_low', 7)} AS ci_low, {rnd('ci_high', 7)} AS ci_high, excludes_zero FROM bt"""


def _rounds() -> str:
    """The keyed permutation, one common table expression per round."""
    prime, out = 2147483647, []
    for j in range(12):
        source = "dr" if j == 0 else f"x{j - 1}"
        out.append(f"""p{j} AS (SELECT *, (key % {prime} + {j * 1_000_003}) % {prime} AS r, ((key >> 29) % {prime} + {j * 7919}) % {prime} AS s FROM {source}),
q{j} AS (SELECT *, ((r * s) % {prime} % gn - x + gn) % gn AS y FROM p{j}),
x{j} AS (SELECT * EXCLUDE (x, y, r, s), CASE WHEN ((((greatest(x, y) * 48271 + r) % {prime}) * ((greatest(x, y) * 69621 + s) % {prime}) % {prime}) >> 12) % 2 = 1 THEN y ELSE x END AS x FROM q{j})""")
    return ",\n".join(out)


NULL = f"""po AS (SELECT as_of, capture_ord, ticker, drift, r2 AS v FROM gn WHERE drift IS NOT NULL AND r2 IS NOT NULL),
bi AS (SELECT *, CAST(floor((rank() OVER (PARTITION BY as_of ORDER BY drift) - 1) * 5 / CAST(count(*) OVER (PARTITION BY as_of) AS DOUBLE)) AS INTEGER) AS bin FROM po),
nu AS (SELECT *, row_number() OVER (PARTITION BY as_of, bin ORDER BY md5(CAST(ticker AS VARCHAR))) - 1 AS idx, count(*) OVER (PARTITION BY as_of, bin) AS gn FROM bi),
pk AS (SELECT m.scheme, nu.* FROM mem m JOIN nu ON nu.as_of = m.as_of AND nu.ticker = m.ticker),
wt AS (SELECT scheme, as_of, bin, count(*) AS k, max(gn) AS gn FROM pk GROUP BY 1, 2, 3),
dr AS (SELECT scheme, as_of, bin, rep, gn, unnest(range(0, k)) AS x,
   CAST('0x' || substr(md5('11-' || scheme || '-' || CAST(as_of AS VARCHAR) || '-' || bin || '-' || rep), 1, 15) AS BIGINT) AS key
  FROM wt, (SELECT unnest(range(0, 199)) AS rep)),
{_rounds()},
ns AS (SELECT d.scheme, d.as_of, d.rep, sum(v) AS s, count(*) AS n FROM x11 d JOIN nu ON nu.as_of = d.as_of AND nu.bin = d.bin AND nu.idx = d.x GROUP BY 1, 2, 3),
nm AS (SELECT scheme, cutoff, rep, sum(s) / sum(n) AS m FROM ns JOIN cut ON CAST(as_of + INTERVAL 1 MONTH AS DATE) <= cutoff GROUP BY 1, 2, 3),
na AS (SELECT scheme, cutoff, avg(v) AS actual, count(*) AS entries FROM pk JOIN cut ON CAST(as_of + INTERVAL 1 MONTH AS DATE) <= cutoff GROUP BY 1, 2),
nl AS (SELECT na.scheme, na.cutoff, actual, entries, count(*) AS reps, avg(m) AS null_mean,
   (count(*) FILTER (round(m, 10) >= round(actual, 10)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value
  FROM na JOIN nm ON nm.scheme = na.scheme AND nm.cutoff = na.cutoff GROUP BY 1, 2, 3, 4)"""
SQL["drift_matched_null"] = f"""WITH RECURSIVE {MEMBERS}, {LAST}, {NULL}
SELECT scheme, cutoff, {rnd('actual', 7)} AS actual, entries, reps, {rnd('null_mean', 7)} AS null_mean, {rnd('p_value', 6)} AS p_value FROM nl"""

SQL["quarterly_verdicts"] = f"""WITH RECURSIVE {NET}, {CUTS}, {BOOT}, {NULL},
b0 AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY p_value, scheme) AS rk FROM nl),
b1 AS (SELECT *, coalesce(rk <= max(CASE WHEN p_value <= rk * 0.1e0 / 5 THEN rk END) OVER (PARTITION BY cutoff), FALSE) AS survives_null FROM b0),
sl AS (SELECT scheme, '1w' AS h, gross_1w AS v, CAST(as_of + INTERVAL 7 DAY AS DATE) AS d FROM ne UNION ALL SELECT scheme, '1m', gross, CAST(as_of + INTERVAL 1 MONTH AS DATE) FROM ne
  UNION ALL SELECT scheme, '3m', gross_3m, CAST(as_of + INTERVAL 3 MONTH AS DATE) FROM ne),
sg AS (SELECT scheme, cutoff, coalesce(sign(avg(v) FILTER (h = '1w')) = sign(avg(v) FILTER (h = '1m')) AND sign(avg(v) FILTER (h = '3m')) = sign(avg(v) FILTER (h = '1m')), FALSE) AS sign_stable
  FROM sl JOIN cut ON d <= cutoff WHERE v IS NOT NULL GROUP BY 1, 2),
d0 AS (SELECT scheme, cutoff, net, avg(net) OVER w AS mu FROM kn JOIN cut ON known_on <= cutoff WINDOW w AS (PARTITION BY scheme, cutoff)),
d1 AS (SELECT scheme, cutoff, count(*) AS t, any_value(mu) / nullif(stddev_samp(net), 0) AS sr, avg((net - mu) ** 3) / nullif(power(avg((net - mu) ** 2), 1.5), 0) AS skew,
  avg((net - mu) ** 4) / nullif(power(avg((net - mu) ** 2), 2), 0) AS kurt FROM d0 GROUP BY 1, 2),
d2 AS (SELECT *, (sr - stddev_samp(sr) OVER (PARTITION BY cutoff) * {_PEAK}) * sqrt(t - 1e0) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM d1),
ds AS (SELECT scheme, cutoff, {cdf('z')} AS dsr FROM d2),
cn AS (SELECT cutoff, count(*) AS captures FROM cut JOIN caps ON as_of <= cutoff GROUP BY 1),
v0 AS (SELECT bt.*, p_value, survives_null, sign_stable, dsr, captures, captures >= 26 AND cohorts >= 20 AS eligible,
   coalesce(excludes_zero AND survives_null AND sign_stable, FALSE) AS keep
  FROM bt LEFT JOIN b1 USING (scheme, cutoff) LEFT JOIN sg USING (scheme, cutoff) LEFT JOIN ds USING (scheme, cutoff) LEFT JOIN cn USING (cutoff)),
v1 AS (SELECT *, eligible AND keep AND coalesce(mean >= 0.0025 AND dsr >= 0.9, FALSE) AS graduates FROM v0),
v2 AS (SELECT *, coalesce(bool_or(graduates) OVER (PARTITION BY scheme ORDER BY cutoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS before FROM v1)
SELECT scheme, cutoff, cohorts, CAST(blocks AS INTEGER) AS blocks, {rnd('mean', 7)} AS mean, {rnd('ci_low', 7)} AS ci_low, {rnd('ci_high', 7)} AS ci_high, excludes_zero,
  {rnd('p_value', 6)} AS p_value, survives_null, sign_stable, {rnd('dsr', 5)} AS dsr, captures, eligible, keep, graduates,
  CASE WHEN captures < 8 THEN 'accruing' WHEN NOT eligible THEN 'interim' WHEN before AND NOT keep THEN 'monitor' WHEN before OR graduates THEN 'graduated'
    WHEN keep THEN 'kept' ELSE 'dropped' END AS standing FROM v2"""
