"""Time helpers: all on UTC timestamps, all with an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the preset funding range that starts on 2025-07-01.
FUNDING_PRESETS = ("q3_2025", "q3_2025_to_now", "q3-2025", "q3-2025-to-now", "recent")
FUNDING_START = "2025-07-01 00:00:00"


def ts(value) -> Column:
    """Literal timestamp from a string or datetime; columns pass through."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime) and value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value).cast("timestamp")


def epoch(c: Column) -> Column:
    """Seconds since the epoch with fractions, as double."""
    return F.unix_micros(c).cast("double") / F.lit(1e6)


def observed_bucket(c: Column, minutes: int = 60) -> Column:
    """``{minutes}m:{bucket number}`` of a timestamp."""
    seconds = max(1, minutes) * 60
    number = F.floor(F.unix_timestamp(c) / F.lit(seconds)).cast("bigint").cast("string")
    return F.concat(F.lit(f"{minutes}m:"), number)


def parse_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp; anything else becomes null."""
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(t))


def age_days(c: Column, as_of) -> Column:
    """Fractional days from ``c`` to ``as_of``; negative when ``c`` lies ahead."""
    return (epoch(ts(as_of)) - epoch(c)) / F.lit(86400.0)


def display_tz(c: Column) -> Column:
    """Analyst-facing time, one fixed hour ahead of UTC."""
    return c + F.expr("interval 1 hour")


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def funding_range(value: str | None, as_of) -> tuple[Column | None, Column | None]:
    """(since, until) for a preset name or an ISO date; (None, None) when unreadable."""
    if not value:
        return None, None
    text = value.strip().lower()
    if text in FUNDING_PRESETS:
        return ts(FUNDING_START), ts(as_of)
    try:
        parsed = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None, None
    return ts(parsed), ts(as_of)
