"""Fixed domains and record schemas of the panel."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: label order, best first -------------------------------------------------
CONSENSUS_ORDER = ["Strong Buy", "Moderate Buy", "Hold", "Moderate Sell", "Strong Sell"]
BUY_LABELS = ["Strong Buy", "Moderate Buy"]

# ---- fixed values: target index names ------------------------------------------------------
TARGET_INDICES = ["S&P 500", "S&P MidCap 400"]

# ---- fixed values: canonical field -> lower-case header fragments, most specific first -----
HEADER_FRAGMENTS = {
    "ticker": ["ticker", "symbol"],
    "company": ["name", "company"],
    "best_analyst_price_target": ["best price target"],
    "best_analyst_upside_pct": ["upside/downside"],
    "best_analyst_consensus": ["best analyst consensus"],
    "most_accurate_analyst": ["most accurate analyst"],
    "most_profitable_analyst": ["most profitable analyst"],
    "analyst_price_target_upside_pct": ["analyst price target %"],
    "analyst_price_target": ["analyst price target"],
    "analyst_consensus": ["analyst consensus"],
    "last_rating_date": ["last rating date"],
    "smart_score": ["smart score"],
    "investor_sentiment": ["investor sentiment"],
    "insider_signal": ["insider"],
    "news_sentiment": ["news sentiment"],
    "hedgefund_signal": ["hedge fund"],
    "blogger_sentiment": ["blogger"],
    "media_buzz": ["media buzz"],
    "sector": ["sector"],
    "dividend_yield": ["dividend yield"],
    "pe_ratio": ["p/e ratio"],
    "market_cap": ["market cap"],
    "price": ["price"],
    "change_pct": ["change %"],
}
NUMERIC_FIELDS = [
    "best_analyst_price_target", "best_analyst_upside_pct", "analyst_price_target_upside_pct",
    "analyst_price_target", "smart_score", "dividend_yield", "pe_ratio", "market_cap", "price",
    "change_pct",
]
# ---- fixed values: fields a capture cannot do without --------------------------------------
CORE_FIELDS = [
    "ticker", "company", "sector", "market_cap", "smart_score", "analyst_consensus",
    "best_analyst_consensus", "analyst_price_target", "best_analyst_price_target",
    "last_rating_date", "insider_signal",
]
# ---- fixed values: names a published aggregate may not carry -------------------------------
BANNED_EXACT = ["ticker", "company", "rows", "table"]
BANNED_ANYWHERE = ["best_analyst_price_target", "last_rating_date"]

# ---- fixed values: thresholds --------------------------------------------------------------
ROW_TOLERANCE = 0.05
MIN_OVERLAP = 0.90
MOVE_FLOOR = 0.0025
FLOW_FLOOR_PCT = 0.25
PRICE_FLOOR = 5.0
ADV_FLOOR = 10_000_000.0
MATURE_DAYS = 31
MIN_CAPTURES = 8
TRAILING_SESSIONS = 252
MIN_TRAILING = 120
STALE_SESSIONS = 3

SECTOR_BLANK = "—"


def record_type(field: str) -> T.DataType:
    return T.DoubleType() if field in NUMERIC_FIELDS else T.StringType()


SNAPSHOT = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("as_of", T.DateType()),
        T.StructField("hhmm", T.StringType()),
        *[T.StructField(f, record_type(f)) for f in HEADER_FRAGMENTS],
    ]
)
