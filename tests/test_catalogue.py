"""The catalogue of queries: no helper replaces another, and the merged panel from rows of its own."""

import ast
import datetime as dt
from collections import Counter

from panelflow.plans import catalogue
from panelflow.plans.catalogue import QUERIES
from panelflow.session import attach


def test_no_name_of_the_catalogue_is_defined_twice():
    with open(catalogue.__file__) as f:
        names = Counter(x.name for x in ast.parse(f.read()).body if isinstance(x, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []


def test_merged_panel_and_funnel_from_own_rows(spark, tmp_path):
    day = dt.date(1995, 1, 2)
    tables = {
        "orders": (["o_orderkey", "o_orderdate"], [(1, day), (2, dt.date(1995, 4, 3))]),
        "part": (["p_partkey", "p_brand", "p_type"], [(1, "Brand#1", "SMALL"), (2, "Brand#2", "PROMO")]),
        "lineitem": (
            ["l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag"],
            [(1, day, 10, 1000.0, 0.0, "F", "N"), (1, dt.date(1995, 2, 1), 10, 2000.0, 0.5, "F", "N"), (2, day, 1, 5.0, 0.0, "O", "R")],
        ),
    }
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.ticker, r.as_of): r for r in QUERIES["panel_merge"](spark, str(tmp_path)).collect()}
    # as_of precedes the first bar; the promotion's spelling resolves to no feed symbol
    first, second = dt.date(1995, 1, 1), dt.date(1995, 4, 1)
    assert set(got) == {(t, d) for t in ("Brand-1", "Brand_2") for d in (first, second)}
    row = got["Brand-1", second]
    assert (row.close_tr, row.member_of, row.matched, row.in_universe) == (200.0, "S&P 500", True, True)
    assert got["Brand-1", first].close_tr is None and not got["Brand_2", second].matched
    funnel = {r.as_of: (r.snapshot, r.matched, r.in_universe) for r in QUERIES["liquid_funnel"](spark, str(tmp_path)).collect()}
    assert funnel == {first: (2, 1, 0), second: (2, 1, 1)}


def test_realised_prices_meet_only_liquid_rows_whose_moves_are_known(spark, monkeypatch):
    """A join of the whole panel by symbol dealt it out twice, by symbol and then by name again."""
    seen = []
    monkeypatch.setattr(catalogue, "attach", lambda big, stats, on: seen.append((big, on)) or attach(big, stats, on))
    assert QUERIES["retained_top20"](spark, "/root/testdata/sf0.001").columns == ["as_of", "ticker", "place", "sector"]
    big, on = seen[0]
    assert on == ["symbol", "as_of"] and {"dir", "confirmed", "target_pct"} <= set(big.columns) and big.where("NOT liquid").isEmpty()
