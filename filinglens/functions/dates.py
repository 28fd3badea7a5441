"""Date and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filinglens.options import TICKER_MAP_TTL_HOURS


def within_ttl(loaded_at: Column, hours: int = TICKER_MAP_TTL_HOURS, now: Column | None = None) -> Column:
    """True while ``now - loaded_at`` is under the time-to-live (a dimension
    loaded at ``loaded_at`` is still fresh); null audit time → false."""
    now = now if now is not None else F.current_timestamp()
    return F.coalesce(loaded_at > now - F.make_interval(hours=F.lit(hours)), F.lit(False))


def iso_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")
