"""Timestamp scalars.  Results stay TIMESTAMP_NTZ: no session-zone dependence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats accepted by the strict check (one- or two-digit fields, like strptime).
STRICT_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d")
# Formats tried, in order, by the coercion step.
COERCE_FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m", "yyyy-M-d", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _try_ts(text: Column, fmt: str) -> Column:
    """Wall-clock parse into TIMESTAMP_NTZ, NULL when the text does not fit ``fmt``.

    ``try_to_timestamp`` only decides validity; the value comes from
    ``to_timestamp_ntz`` so the session time zone (and its DST gaps) never
    shifts the result.  The CASE keeps the raising form off invalid text.
    """
    return F.when(F.try_to_timestamp(text, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(text, F.lit(fmt)))


def ntz_to_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock (NTZ) timestamp.

    Built from the date and the clock fields, so no session time zone (or DST
    gap) is involved.
    """
    t = F.col(c) if isinstance(c, str) else c
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.date_part(F.lit("SECOND"), t)  # seconds with microsecond fraction
    return (days * F.lit(86_400_000_000) + F.hour(t).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(t).cast("bigint") * F.lit(60_000_000) + (secs * F.lit(1_000_000)).cast("bigint"))


def micros_to_ntz(c) -> Column:
    """Inverse of ``ntz_to_micros`` (wall clock, zone-free)."""
    m = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    day_us = F.lit(86_400_000_000)
    days = F.floor(m / day_us).cast("int")
    rem = m - days.cast("bigint") * day_us
    d = F.date_add(F.lit("1970-01-01").cast("date"), days)
    hours = (rem / F.lit(3_600_000_000)).cast("int")
    minutes = ((rem % F.lit(3_600_000_000)) / F.lit(60_000_000)).cast("int")
    secs = ((rem % F.lit(60_000_000)).cast("decimal(16,0)") / F.lit(1_000_000)).cast("decimal(16,6)")
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), hours, minutes, secs)


def coerce_timestamp(c, formats=COERCE_FORMATS) -> Column:
    """Text -> TIMESTAMP_NTZ; anything unparseable becomes NULL."""
    text = _c(c).cast("string")
    return F.coalesce(*[_try_ts(text, f) for f in formats])


def invalid_timestamp(c) -> Column:
    """True for non-null text that matches none of the strict formats."""
    text = _c(c).cast("string")
    parsed = F.coalesce(*[_try_ts(text, f) for f in STRICT_FORMATS])
    return text.isNotNull() & (parsed.isNull() | (text != F.trim(text)))
