"""Panel, price, membership and event-log views derived from the test warehouse tables.

Every adapter reads whole tables. Column formulas only give the warehouse columns the roles the
operators expect; no adapter drops rows other than by the coverage rule stated with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelflow.functions import clock
from panelflow.operators.asof import number_captures, state_at_captures
from panelflow.schema import ADV_FLOOR, PRICE_FLOOR, TARGET_INDICES
from panelflow.session import settle, stored

COVERAGE_DAYS = 730
EVENT_STEP_HOURS = 31


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is read from the footers once per path."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ---- weekly-panel stand-in -----------------------------------------------------------------


def panel_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter starts, numbered, with the neighbouring capture dates."""
    quarter = F.to_date(F.date_trunc("quarter", F.col("o_orderdate")))
    days = table(spark, sf_dir, "orders").select(quarter.alias("as_of")).distinct()
    w = Window.orderBy("as_of")
    return settle(
        number_captures(days, ["as_of"])
        .withColumn("prev_as_of", F.lag("as_of").over(w))
        .withColumn("next_as_of", F.lead("as_of").over(w))
    )


def ratings_panel(spark: SparkSession, sf_dir: str, captures: DataFrame | None = None) -> DataFrame:
    """One row per (capture, customer): the customer's latest order as a merged panel record.

    A customer is on the export while its latest order is at most COVERAGE_DAYS old.
    """
    captures = panel_captures(spark, sf_dir) if captures is None else captures
    orders = table(spark, sf_dir, "orders")
    state = state_at_captures(
        orders,
        key="o_custkey",
        ts="o_orderdate",
        tie=["o_orderkey"],
        payload=["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority"],
        captures=captures,
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    status, price, priority = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    label = (
        F.when(priority == "1-URGENT", "Strong Buy")
        .when(priority == "2-HIGH", "Moderate Buy")
        .when(priority == "3-MEDIUM", "Hold")
        .when(priority == "5-LOW", "Moderate Sell")
    )
    levels = F.floor(price / 62500.0).cast("double")
    score = (F.col("o_orderkey") % 10 + 1).cast("double")
    bands = F.floor(price / 100000.0)
    index = F.when(nation < 10, F.array(F.lit(TARGET_INDICES[0]))).when(
        nation < 20, F.array(F.lit(TARGET_INDICES[1]))
    )
    matched = ~((status == "F") & (priority == "1-URGENT"))
    return (
        state.where(F.date_diff("as_of", F.to_date("o_orderdate")) <= COVERAGE_DAYS)
        .join(customer, "o_custkey")
        .select(
            "as_of", "capture_ord", "prev_as_of", "next_as_of",
            F.col("o_custkey").alias("ticker"),
            F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("sector"),
            label.alias("analyst_consensus"),
            F.when(price >= 10000, F.lit(100.0) + levels * F.lit(0.1)).alias("best_analyst_price_target"),
            price.alias("analyst_price_target"),
            ((price - 250000.0) / 5000.0).alias("analyst_price_target_upside_pct"),
            ((price - 100000.0) / 10000.0).alias("best_analyst_upside_pct"),
            F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 120).cast("int")).alias("rating_date"),
            F.when(~((status == "P") & (priority == "5-LOW")), score).alias("smart_score"),
            F.when(status == "P", "Positive").when(status == "F", "Negative").alias("insider_signal"),
            F.when(price < 100000, "Bearish").when(price < 400000, "Neutral").otherwise("Bullish").alias("news_sentiment"),
            F.when(bands == 0, "Very Negative").when(bands == 1, "Negative").when(bands == 3, "Positive")
            .when(bands == 4, "Very Positive").alias("investor_sentiment"),
            (price * 100000.0).alias("market_cap"),
            F.when(status != "O", F.round(price / 100000.0, 1)).alias("dividend_yield"),
            ((balance * 100.0 + price) / 25000.0 - 20.0).alias("tr_3m_pct"),
            F.when(balance > 0, balance / 250.0 + 10.0).alias("vol_ann_pct"),
            matched.alias("matched"),
            F.coalesce(index, F.array().cast("array<string>")).alias("member_of"),
            (balance / 100.0).alias("close_tr"),
            (price * 500.0).alias("adv_usd"),
        )
        .withColumn("in_universe", F.col("matched") & (F.size("member_of") > 0))
        .withColumn(
            "liquid",
            F.col("in_universe") & (F.col("close_tr") >= PRICE_FLOOR) & (F.col("adv_usd") >= ADV_FLOOR),
        )
    )


def document_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the fields only documents show: company, best analysts' label, fund signal, two analysts, rating date as text.

    Tickers begin with a letter, as those of an export do: bare numbers would stand in a document as buckets of its histogram.
    Nations and regions are the fixed 25 and 5 rows of the tables, which bounds their broadcast.
    """
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("most_accurate_analyst"), F.col("r_name").alias("most_profitable_analyst"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("company"), "c_nationkey")
    best, level = F.col("best_analyst_upside_pct"), F.col("close_tr")
    return (
        ratings_panel(spark, sf_dir)
        .join(names, "ticker")
        .join(F.broadcast(nation), "c_nationkey", "left")
        .drop("c_nationkey")
        .withColumns({
            "ticker": F.concat(F.lit("C"), F.col("ticker").cast("string")),
            "best_analyst_consensus": F.when(best >= 30, "Strong Buy").when(best >= 10, "Hold"),
            "hedgefund_signal": F.when(level >= 60, "Increased").when(level >= 30, "Decreased"),
            "last_rating_date": F.date_format("rating_date", "yyyy-MM-dd"),
        })
    )


def charted_names(panel: DataFrame) -> DataFrame:
    """Names matched at two captures or more, so that there is a line to draw."""
    return panel.groupBy("ticker").agg(F.count_if("matched").alias("points")).where("points >= 2").select("ticker")


def graded_panel(spark: SparkSession, sf_dir: str, captures: DataFrame | None = None) -> DataFrame:
    """Panel with a beta and three forward measures: the target's change one, two and three
    captures on, in hundredths, where the name is still on the export then."""
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    panel = ratings_panel(spark, sf_dir, captures).withColumn("beta", F.col("vol_ann_pct") / 25.0)
    # the record k captures on is among the next k records of the name
    ahead = [F.lead(F.struct("capture_ord", "analyst_price_target"), j).over(w) for j in (1, 2, 3)]
    panel = panel.withColumns({f"_a{j}": a for j, a in enumerate(ahead, 1)})
    for k, name in ((1, "alpha_1w"), (2, "alpha_1m"), (3, "alpha_3m")):
        level = F.coalesce(
            *[F.when(F.col(f"_a{j}.capture_ord") == F.col("capture_ord") + k, F.col(f"_a{j}.analyst_price_target")) for j in range(1, k + 1)]
        )
        panel = panel.withColumn(name, (level / F.col("analyst_price_target") - 1.0) / 100.0)
    return panel.drop("_a1", "_a2", "_a3")


# ---- price and membership stand-ins --------------------------------------------------------


def _bars(lines: DataFrame, symbol) -> DataFrame:
    """Volume-weighted close per (symbol, session); money is summed as DECIMAL, so the result
    does not depend on row order. `close` is the total-return series, `close_capital` the
    capital one."""
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    kept = gross * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    qty = F.sum(F.col("l_quantity").cast("decimal(18,0)")).cast("double")
    return lines.groupBy(symbol.alias("symbol"), F.to_date("l_shipdate").alias("session")).agg(
        (F.sum(gross).cast("double") / qty).alias("close"),
        (F.sum(kept).cast("double") / qty).alias("close_capital"),
        qty.alias("volume"),
    )


def feed_symbol(brand) -> Column:
    return F.upper(F.regexp_replace(brand, "#", "-"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: unique per (symbol, session), hence bounded by the calendar."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    return _bars(lines.join(part, "p_partkey"), feed_symbol(F.col("p_brand")))


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse bars per part: many symbols, gaps, early ends."""
    return _bars(table(spark, sf_dir, "lineitem"), F.col("l_partkey"))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market proxy: every line of a session."""
    return _bars(table(spark, sf_dir, "lineitem"), F.lit("MARKET")).drop("symbol")


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars per brand and the market proxy from one pass over the lines, whose sums are stored once."""
    part = table(spark, sf_dir, "part").select("p_partkey", feed_symbol(F.col("p_brand")).alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("session"),
        F.col("l_quantity").cast("decimal(18,0)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"),
    )
    sums = stored(lines.join(part, "p_partkey").groupBy("symbol", "session").agg(F.sum("v").alias("v"), F.sum("q").alias("q")), "feed")
    close = (F.sum("v").cast("double") / F.sum("q").cast("double")).alias("close")
    return sums.groupBy("symbol", "session").agg(close), sums.groupBy("session").agg(close)


def panel_symbol(ticker: Column) -> Column:
    """Feed symbol that a panel name is priced by: one of the 25 brands."""
    return F.concat(F.lit("BRAND-"), (ticker % 25 + 1).cast("string"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()


def order_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 membership series per (customer, priority class), the day's highest order wins."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_custkey").alias("symbol"),
        F.col("o_orderpriority").alias("index_name"),
        F.to_date("o_orderdate").alias("session"),
    ).agg(F.max_by(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0), "o_orderkey").alias("is_member"))


def brand_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 membership series per (brand, line status as index) from the day's return flags."""
    part = table(spark, sf_dir, "part").select("p_partkey", feed_symbol(F.col("p_brand")).alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_linestatus", "l_returnflag"
    )
    index = F.when(F.col("l_linestatus") == "F", TARGET_INDICES[0]).otherwise(TARGET_INDICES[1])
    vote = F.sum(F.when(F.col("l_returnflag") == "N", 1).otherwise(-1))
    return (
        lines.join(part, "p_partkey")
        .groupBy("symbol", index.alias("index_name"), F.to_date("l_shipdate").alias("session"))
        .agg(F.when(vote >= 0, 1).otherwise(0).alias("is_member"))
    )


def export_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export spellings of the brands: one ticker per (brand, part type), some not resolvable."""
    sep = (
        F.when(F.col("p_type") == "ECONOMY", ".")
        .when(F.col("p_type") == "SMALL", "-")
        .when(F.col("p_type") == "STANDARD", "/")
        .when(F.col("p_type") == "PROMO", "_")
        .otherwise("-")
    )
    return (
        table(spark, sf_dir, "part")
        .select("p_brand", "p_type")
        .distinct()
        .select(F.regexp_replace("p_brand", "#", "-").alias("_b"), sep.alias("_s"), "p_type")
        .select(F.expr("replace(_b, '-', _s)").alias("ticker"), F.col("p_type").alias("sector"))
    )


# ---- daily-log stand-in --------------------------------------------------------------------


def event_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture instants every 31 hours from the second day of the log to its end.

    An instant is Singapore wall clock; `et` is the same instant in US Eastern.
    """
    log = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start = (F.date_trunc("day", F.col("a")) + F.expr("INTERVAL 1 DAY")).cast("timestamp")
    step = F.expr(f"INTERVAL {EVENT_STEP_HOURS} HOURS")
    ts = log.select(F.explode(F.sequence(start, F.col("b").cast("timestamp"), step)).alias("t"))
    numbered = number_captures(ts.select(F.col("t").cast("timestamp_ntz").alias("cap_ts")), ["cap_ts"], 0)
    return settle(numbered.withColumn("et", clock.singapore_to_eastern(F.col("cap_ts"))))


def event_log(spark: SparkSession, sf_dir: str, captures: DataFrame | None = None) -> DataFrame:
    """State of every user at every capture instant as a daily-log record."""
    captures = event_instants(spark, sf_dir) if captures is None else captures
    state = state_at_captures(
        table(spark, sf_dir, "events"),
        key="user_id",
        ts="ts",
        tie=["event_id"],
        payload=["event_id", "ts", "event_type", "value"],
        captures=captures,
        at="cap_ts",
    )
    kind = F.col("event_type")
    label = (
        F.when(kind == "purchase", "Strong Buy")
        .when(kind == "signup", "Moderate Buy")
        .when(kind == "click", "Hold")
        .when(kind == "view", "Moderate Sell")
        .when(kind == "error", "Strong Sell")
    )
    return state.select(
        "capture_ord", "cap_ts", "et",
        F.col("user_id").alias("ticker"),
        label.alias("analyst_consensus"),
        (F.lit(100.0) + F.floor(F.col("value") / 20.0).cast("double") * F.lit(0.1)).alias("best_analyst_price_target"),
        # large events restamp the rating date; otherwise the name keeps its opening date
        F.when(F.col("value") > 150, F.date_sub(F.to_date("ts"), (F.col("event_id") % 4).cast("int")))
        .otherwise(F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 5).cast("int")))
        .alias("rating_date"),
        F.col("value"),
    )


# ---- text-cell, export and capture-header stand-ins ----------------------------------------


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values written in eight export styles."""
    v = F.col("value").cast("string")
    style = F.col("event_id") % 8
    text = (
        F.when(style == 0, F.concat(F.lit("$"), v, F.lit("M")))
        .when(style == 1, F.concat(F.lit("("), v, F.lit("%)")))
        .when(style == 2, F.concat(v, F.lit("% Downside")))
        .when(style == 3, F.lit("n/a"))
        .when(style == 4, F.concat(F.lit("-"), v, F.lit("%")))
        .when(style == 5, F.concat(F.lit("$"), v, F.lit(" (51.54% Upside)")))
        .when(style == 6, F.concat(F.lit("  $4,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(",100 ")))
        .otherwise(F.concat(v, F.lit(" bps")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("cell"))


def date_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in the export's date styles, some unreadable."""
    d = F.col("o_orderdate")
    style = F.col("o_orderkey") % 6
    text = (
        F.when(style == 0, F.date_format(d, "MMM dd, yyyy"))
        .when(style == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(style == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 3, F.concat(F.lit("rated "), F.date_format(d, "MMM d, yyyy"), F.lit(" by desk")))
        .when(style == 4, F.concat(F.lit("Feb 30, "), F.year(d).cast("string")))
        .otherwise(F.lit("pending"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("cell"))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text export of every quarter: one row per order, pages by priority, keys repeat."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    price = F.col("o_totalprice")
    money = F.concat(F.lit("$"), F.col("o_orderkey").cast("string"), F.lit(".25K"))
    return o.join(c, "o_custkey").select(
        F.to_date(F.date_trunc("quarter", F.col("o_orderdate"))).alias("as_of"),
        F.concat(F.lit(" t"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("Ticker"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Sector"),
        money.alias("Price"),
        F.concat(F.lit("$"), (F.col("o_orderkey") * 3).cast("string")).alias("Best Price Target Upside"),
        F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(".5% Downside")).alias("Top Analysts' Price Target - upside/downside"),
        F.concat((F.col("o_orderkey") % 70).cast("string"), F.lit(".25%")).alias("Analyst Price Target %"),
        F.concat(F.lit("$"), (F.col("o_orderkey") * 2).cast("string"), F.lit("M")).alias("Analyst Price Target"),
        F.substring("o_orderpriority", 3, 20).alias("Analyst Consensus"),
        F.date_format("o_orderdate", "MMM dd, yyyy").alias("Last Rating Date"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((F.col("o_orderkey") % 10 + 1).cast("string")).alias("Smart Score"),
        F.col("o_orderstatus").alias("Insider Signal"),
        F.lit("41,527,325.00").alias("Volume"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("_page"),
        F.col("o_orderkey").alias("_row"),
    )


# first year, last year, date of the export
PERIODS = ((1995, 1996, "1996-12-31"), (1997, 1998, "1998-12-31"), (1999, 2001, "2001-12-31"))


def period_exports(spark: SparkSession, sf_dir: str, path: str) -> None:
    """CSV exports of all orders below `path`: one folder per period, in it one per priority page, rows by order key."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    period = F.coalesce(*[F.when(F.year("o_orderdate") <= last, i) for i, (_, last, _) in enumerate(PERIODS, 1)], F.lit(len(PERIODS)))
    key = F.col("o_orderkey")
    rows = o.join(c, "o_custkey").select(
        period.alias("period"), F.substring("o_orderpriority", 1, 1).cast("int").alias("page"), key.alias("_row"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("Ticker"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Sector"),
        F.concat(F.lit("$"), key.cast("string"), F.lit(".25K")).alias("Price"),
        F.concat(F.lit("$"), (key * 5).cast("string"), F.lit("M")).alias("Market Cap"),
        F.concat(F.lit("$"), (key * 3).cast("string")).alias("Best Price Target Upside"),
        F.concat(F.lit("$"), (key * 2).cast("string"), F.lit("M")).alias("Analyst Price Target"),
        F.substring("o_orderpriority", 3, 20).alias("Analyst Consensus"),
        F.substring("o_orderpriority", 3, 20).alias("Best Analyst Consensus"),
        F.date_format("o_orderdate", "MMM dd, yyyy").alias("Last Rating Date"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((key % 10 + 1).cast("string")).alias("Smart Score"),
        F.col("o_orderstatus").alias("Insider Signal"),
        F.lit("41,527,325.00").alias("Volume"),
    )
    # ranges of (period, page, key) keep the order of rows in the order of file names
    ranged = rows.repartitionByRange("period", "page", "_row").sortWithinPartitions("period", "page", "_row").drop("_row")
    ranged.write.partitionBy("period", "page").option("header", True).csv(path)


def capture_headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Header and member tables of the raw quarterly exports."""
    o = table(spark, sf_dir, "orders").select(
        F.to_date(F.date_trunc("quarter", F.col("o_orderdate"))).alias("as_of"), F.col("o_custkey").alias("ticker"), "o_orderkey"
    )
    caps = panel_captures(spark, sf_dir).select("as_of", "capture_ord")
    keyed = o.groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("k"))
    keyed = keyed.join(F.broadcast(caps), "as_of")  # one row per quarter
    digest = F.sha2(F.concat_ws("-", F.sum("n").cast("string"), F.sum("k").cast("string")), 256)
    fields = ["ticker", "company", "sector", "market_cap", "smart_score", "analyst_consensus", "best_analyst_consensus",
              "analyst_price_target", "best_analyst_price_target", "last_rating_date", "insider_signal"]
    headers = keyed.groupBy("as_of", "capture_ord").agg(
        F.sum("n").alias("n_raw"), F.count(F.lit(1)).alias("n_rows"), F.array(digest).alias("sha256")
    ).select(
        "*",
        F.array(*[F.lit(f) for f in fields]).alias("mapped_fields"),
        F.array(F.lit("Volume")).alias("unmapped_columns"),
        F.lit(1).alias("copies"),
    )
    return headers, keyed.select("capture_ord", "ticker")


def both_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture dimension of both streams: quarterly untimed and event-log timed captures."""
    weekly = panel_captures(spark, sf_dir).select(F.lit("weekly").alias("stream"), "as_of", F.lit("").alias("hhmm"))
    clock_text = F.date_format("cap_ts", "HHmm")
    daily = event_instants(spark, sf_dir).select(
        F.lit("daily").alias("stream"), F.to_date("cap_ts").alias("as_of"),
        F.when(clock_text == "0000", "").otherwise(clock_text).alias("hhmm"),
    )
    return weekly.unionByName(daily)


def quoted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for the leak scan: benchmark words in path form, as page links carry them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return words.select(F.concat(F.lit("/"), F.col("w")).alias("key")).distinct()
