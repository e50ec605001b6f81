"""Times of the log as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_TICKS = 116444736000000000
_LAST_NATIVE = 2650467743999999999  # ticks at the end of 9999


def filetime_timestamp(ticks: Column) -> Column:
    """A count of 100 ns since 1601 as a timestamp in microseconds; null for zero and after 9999."""
    t = ticks.cast("bigint") - EPOCH_TICKS
    micros = F.call_function("div", t - F.pmod(t, F.lit(10).cast("bigint")), F.lit(10).cast("bigint"))
    return F.when((ticks > 0) & (ticks <= _LAST_NATIVE), F.timestamp_micros(micros))


def filetime_iso(ticks: Column) -> Column:
    """ISO text with seven digits; empty for zero. Years after 9999 are written with all their digits."""
    whole, wide = ticks.cast("decimal(20,0)"), F.lit(10_000_000).cast("decimal(20,0)")
    small = whole <= F.lit((1 << 63) - 1).cast("decimal(20,0)")  # in 64 bits, which is much faster
    short = whole.cast("bigint")
    seconds = F.when(small, F.call_function("div", short, F.lit(10_000_000).cast("bigint"))).otherwise(F.floor(whole / wide).cast("bigint")) - 11644473600
    rest = F.when(small, F.pmod(short, F.lit(10_000_000).cast("bigint"))).otherwise(F.pmod(whole, wide).cast("bigint"))
    fraction = F.lpad(rest.cast("string"), 7, "0")
    cycle = 12622780800  # seconds in 400 years
    late = F.greatest(F.lit(0), F.floor((seconds - 253402300800) / F.lit(float(cycle))).cast("bigint") + 1)
    at = F.timestamp_seconds(F.when(seconds < 253402300800, seconds).otherwise(seconds - late * cycle))
    year = F.year(at) + F.when(seconds < 253402300800, F.lit(0).cast("bigint")).otherwise(late * 400)
    year_text = F.when(year < 1000, F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.when(whole == 0, "").otherwise(F.concat(year_text, F.date_format(at, "-MM-dd'T'HH:mm:ss."), fraction, F.lit("Z")))


def iso_millis(timestamp: Column) -> Column:
    """Milliseconds since 1970 of an ISO text; null where it is none."""
    return F.floor(F.unix_micros(F.try_to_timestamp(F.regexp_replace(timestamp, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6})\d*Z$", "$1Z"))) / 1000).cast("bigint")


def relative_time(at: Column, now: Column) -> Column:
    """How long ago in minutes, hours or days; a date from seven days on."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000)
    return (
        F.when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 60 * 24, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 60 * 24 * 7, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(at, "MMM d, hh:mm a"))
    )
