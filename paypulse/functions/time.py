"""Zone-less time: literals, bucket starts and window bounds.

Event times are UTC wall clock without a zone. All bounds are computed once, in
UTC, when a query is built, so no result depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

_GRAINS = {
    "second": timedelta(seconds=1),
    "minute": timedelta(minutes=1),
    "hour": timedelta(hours=1),
    "day": timedelta(days=1),
}
_EPOCH = datetime(1970, 1, 1)


def as_utc(as_of: datetime | str | None) -> datetime:
    """``as_of`` as naive UTC; ``None`` is the current time."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    elif isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def ntz(value: datetime) -> Column:
    """A TIMESTAMP_NTZ literal; folds to a constant, so filters on it reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def minutes_before(as_of: datetime, minutes: int) -> datetime:
    """``as_of`` moved ``minutes`` into the past; negative spans are refused."""
    minutes = int(minutes)
    if minutes < 0:
        raise ValueError("minutes must not be negative")
    return as_of - timedelta(minutes=minutes)


def shift_minutes(ts: Column, minutes: int) -> Column:
    """``ts`` moved by ``minutes`` (may be negative); NULL stays NULL."""
    return F.timestamp_add("MINUTE", F.lit(int(minutes)), ts)


def bucket_start(ts: Column, grain: str = "minute") -> Column:
    """Start of the ``grain`` bucket of a TIMESTAMP_NTZ column; NULL stays NULL.

    ``window`` is plain arithmetic on the microseconds, so it is several times
    faster than ``date_trunc`` on zone-less times (which converts to the session
    zone and back) and cannot be shifted by daylight saving. It drops NULL times,
    hence the stand-in value. Spark allows one ``window`` per select: bucket two
    different columns in two steps.
    """
    if grain not in _GRAINS:
        raise ValueError(f"grain must be one of {sorted(_GRAINS)}")
    start = F.window(F.coalesce(ts, ntz(_EPOCH)), f"1 {grain}").start
    return F.when(ts.isNotNull(), start)


def bucket_ceil(value: datetime, grain: str = "minute") -> datetime:
    """The first bucket start at or after ``value``.

    ``bucket_start(ts) >= c`` holds exactly when ``ts >= bucket_ceil(c)``, and
    ``bucket_start(ts) < c`` exactly when ``ts < bucket_ceil(c)``; the right-hand
    forms compare the source column itself and are pushed into the Parquet scan.
    """
    step = _GRAINS[grain]
    past = (value - _EPOCH) % step
    return value if not past else value + (step - past)
