"""The three clocks (Singapore date, Singapore instant, US Eastern) and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SGT = "Asia/Singapore"
ET = "America/New_York"

# ---- fixed values: forward horizons --------------------------------------------------------
HORIZONS = {"1w": ("days", 7), "1m": ("months", 1), "3m": ("months", 3)}


def singapore_to_eastern(ts: Column) -> Column:
    """Singapore wall-clock TIMESTAMP_NTZ to US Eastern wall clock, DST from the tz database."""
    return F.convert_timezone(F.lit(SGT), F.lit(ET), ts.cast("timestamp_ntz"))


def stamp_instant(as_of: Column, hhmm: Column) -> Column:
    """Capture key to a Singapore wall-clock instant; an untimed key reads as midnight."""
    h = F.coalesce(F.substring(hhmm, 1, 2).try_cast("int"), F.lit(0))
    m = F.coalesce(F.substring(hhmm, 3, 2).try_cast("int"), F.lit(0))
    return (
        as_of.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m, F.lit(0))
    ).cast("timestamp_ntz")


def window_kind(a: Column, b: Column) -> Column:
    """Session class of the window between two US Eastern instants."""
    clock = lambda t: F.date_format(t, "HH:mm:ss.SSSSSS")
    return (
        F.when(F.to_date(a) != F.to_date(b), "overnight")
        .when(clock(a) < "09:30:00.000000", "pre-open")
        .when(clock(b) <= "16:00:00.000000", "intra-session")
        .otherwise("session+close")
    )


def elapsed_hours(a: Column, b: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(3_600_000_000.0)


def business_days_back(d: Column, n: int) -> Column:
    """Shift a date back by n >= 1 business days (Monday to Friday)."""
    w = F.weekday(d)
    from_weekend = w >= 5
    start = F.when(from_weekend, F.date_add(d, (F.lit(7) - w).cast("int"))).otherwise(d)
    w0 = F.when(from_weekend, F.lit(0)).otherwise(w)
    weekends = F.greatest(F.lit(0), F.ceil((F.lit(n) - w0) / F.lit(5.0)).cast("int"))
    return F.date_sub(start, (F.lit(n) + F.lit(2) * weekends).cast("int"))


def horizon_end(start: Column, horizon: str) -> Column:
    if horizon not in HORIZONS:
        raise KeyError(f"unknown horizon {horizon!r}; expected one of {sorted(HORIZONS)}")
    unit, n = HORIZONS[horizon]
    return F.date_add(start, n) if unit == "days" else F.add_months(start, n)


def horizon_end_by_name(start: Column, name: Column) -> Column:
    out = F.lit(None).cast("date")
    for h in HORIZONS:
        out = F.when(name == h, horizon_end(start, h)).otherwise(out)
    return out
