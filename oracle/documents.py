"""Oracle SQL for the public and private documents."""

from __future__ import annotations

from oracle.base import PAIRS, PANEL, VIEW
from oracle.panel import SQL as SECTIONS

SQL: dict[str, str] = {}

_CHARTED = "ch AS (SELECT ticker FROM panel GROUP BY 1 HAVING count(*) FILTER (matched) >= 2)"
_PAIR = ["pairs", "upgrades", "downgrades", "confirmed_up", "confirmed_down", "target_raises", "target_cuts", "target_raises_confirmed",
         "target_cuts_confirmed", "median_raise_pct", "median_cut_pct", "entered_n", "left_n", "window_days"]
_WEEK = ["liquid", "pct_buy", "median_upside", "median_best_upside", "median_smart_score"]
_MOVES = ["upgrades", "downgrades", "target_raises", "target_cuts"]


def number(path: str, value: str, source: str) -> str:
    return f"SELECT {path} AS path, CAST(NULL AS VARCHAR) AS text, CAST({value} AS DOUBLE) AS number FROM {source}"


def text(path: str, value: str, source: str) -> str:
    return f"SELECT {path} AS path, CAST({value} AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS number FROM {source}"


def tally(axis: str, value: str) -> str:
    return number(f"'sentiment.{axis}.' || v", "n", f"(SELECT {value} AS v, count(*) AS n FROM cur GROUP BY 1) q WHERE v IS NOT NULL")


_LEAVES = [
    text("'as_of'", "as_of", "k"),
    *[number(f"'universe.{c}'", c, "u JOIN k USING (as_of)") for c in ("liquid", "sp500", "sp400")],
    *[number(f"'kpis.{c}'", c, "w JOIN k USING (as_of)") for c in _WEEK],
    number("'smart_score_hist.' || bucket", "n", "h JOIN k USING (as_of)"),
    number("'consensus.' || label", "n", "c JOIN k USING (as_of)"),
    text("'by_sector[' || i || '].sector'", "sector", "s"),
    *[number(f"'by_sector[' || i || '].{c}'", c, "s") for c in ("n", "mean_ss")],
    tally("insider", "insider"),
    tally("hedgefund", "CASE WHEN close_tr >= 60 THEN 'Increased' WHEN close_tr >= 30 THEN 'Decreased' END"),
    tally("investor", "investor"),
    number("'accrual.snapshots'", "snapshots", "a"),
    number("'accrual.min_snapshots'", "8", "a"),
    number("'accrual.matured'", "matured", "a"),
    text("'revision.available'", "'true'", "k"),
    text("'revision.prev_as_of'", "prev_as_of", "p JOIN k USING (as_of)"),
    *[number(f"'revision.{c}'", c, "p JOIN k USING (as_of)") for c in _PAIR],
    text("'weekly[' || i || '].as_of'", "as_of", "wi"),
    *[number(f"'weekly[' || i || '].{c}'", c, "wi") for c in _WEEK + _MOVES],
]
SQL["public_document"] = f"""WITH {PANEL}, k AS (SELECT max(as_of) AS as_of FROM panel),
cur AS (SELECT liq.* FROM liq JOIN k USING (as_of)),
u AS ({SECTIONS["index_counts"]}), w AS ({SECTIONS["weekly_series"]}), h AS ({SECTIONS["score_histogram"]}),
c AS ({SECTIONS["consensus_mix"]}), p AS ({SECTIONS["revision_pair_counts"]}), a AS ({SECTIONS["accrual"]}),
s AS (SELECT q.*, row_number() OVER (ORDER BY n DESC, sector) - 1 AS i FROM ({SECTIONS["sector_summary"]}) q JOIN k USING (as_of)),
wi AS (SELECT *, row_number() OVER (ORDER BY as_of) - 1 AS i FROM w)
""" + " UNION ALL ".join(_LEAVES)

SQL["private_document"] = f"""WITH {VIEW}, {_CHARTED}
SELECT v.as_of, 'C' || v.ticker AS ticker, c_name AS company, v.sector, v.score AS smart_score, v.label AS consensus,
  CASE WHEN v.best_upside >= 30 THEN 'Strong Buy' WHEN v.best_upside >= 10 THEN 'Hold' END AS best_consensus,
  v.upside, v.best_upside, v.tr_3m, v.vol_ann, v.bvc_gap, v.insider,
  CASE WHEN c_acctbal / 100e0 >= 60 THEN 'Increased' WHEN c_acctbal / 100e0 >= 30 THEN 'Decreased' END AS hedgefund,
  v.dividend_yield AS div_yield, v.mktcap_b, v.idx, n_name AS most_accurate, r_name AS most_profitable,
  strftime(l.rating_date, '%Y-%m-%d') AS last_rating, v.news, v.investor, v.upside_per_vol, v.lens_pass, ch.ticker IS NOT NULL AS chart
FROM pview v JOIN liq l ON l.as_of = v.as_of AND l.ticker = v.ticker JOIN customer ON c_custkey = v.ticker
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN ch ON ch.ticker = v.ticker"""

SQL["private_revision"] = f"""WITH {PAIRS} {VIEW[len(PANEL):]}, {_CHARTED}
SELECT em.as_of, 'C' || em.ticker AS ticker, rev_rank, CASE WHEN rev_rank > 0 THEN 'up' WHEN rev_rank < 0 THEN 'down' END AS rev_badge, lens_pass,
  ch.ticker IS NOT NULL AS chart
FROM em LEFT JOIN pview ON pview.as_of = em.as_of AND pview.ticker = em.ticker LEFT JOIN ch ON ch.ticker = em.ticker"""
