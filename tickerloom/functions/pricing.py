"""Price arithmetic as column expressions.  A missing input gives a missing result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom import names


def mid_price(bid: Column, ask: Column) -> Column:
    return ((bid + ask) / 2.0).cast("double")


def joint_volume(bid_volume: Column, ask_volume: Column) -> Column:
    return (bid_volume + ask_volume).cast("double")


def day_range(high: Column, low: Column) -> Column:
    return (high - low).cast("double")


def deviation_pct(price: Column, baseline: Column) -> Column:
    """Percent by which the price is off its baseline; NULL on a zero baseline."""
    return ((price - baseline) / F.nullif(baseline, F.lit(0.0)) * 100.0).cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Round by the value as it is stored, exact halves to even.

    ``F.round`` goes by the shortest text of a double, so 1.08345, which is stored a little
    below that, would become 1.0835 instead of 1.0834.  Formatting goes by the stored value.
    """
    if digits < 4:
        raise ValueError("values from 1e15 on, which are left as they are, have up to 3 decimals")
    text = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    # Formatting takes a lone last 5 for an exact half, so the smallest values are compared instead.
    unit, half = float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    up = F.abs(value) >= half if round(half, digits) > 0 else F.abs(value) > half
    smallest = F.when(up, F.signum(value) * unit).otherwise(F.signum(value) * 0.0)
    return (F.when(F.abs(value) < unit, smallest)
            .when(F.abs(value) < 1e15, text.try_cast("double")).otherwise(value))


def projected_price(price: Column, deviation: Column, volatility: Column) -> Column:
    """The price moved by its own deviation plus a share of the volatility."""
    moved = price + deviation / 100.0 * price + volatility * names.VOLATILITY_WEIGHT
    return rounded(moved, names.FORECAST_DECIMALS)


def within_margin(error: Column, actual: Column, margin: float = names.HIT_MARGIN) -> Column:
    """Whether the error is at most ``margin`` of the actual price.

    NULL when the actual price is zero.  The sign of the actual price is kept, so a
    negative one always counts as a hit.
    """
    return F.try_divide(F.abs(error), actual) <= margin
