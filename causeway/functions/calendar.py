"""Exchange sessions on a weekday calendar, as columns. Instants are UTC; sessions are dates in the asset's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, zone: Column | str) -> Column:
    """Wall-clock time in ``zone`` of a UTC time without zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def local_date(ts: Column, zone: Column | str) -> Column:
    return F.to_date(local_time(ts, zone))


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def to_weekday(d: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    return F.date_sub(d, F.when(F.weekday(d) == 5, 1).when(F.weekday(d) == 6, 2).otherwise(0))


def previous_session(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1))


def next_session(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def completed(ts: Column, session: Column, zone: Column | str, close_minute: Column | int) -> Column:
    """Whether the session, ending ``close_minute`` minutes into its local day, is over at ``ts``."""
    local = local_time(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.to_date(local) > session) | ((F.to_date(local) == session) & (minute >= close_minute))


def baseline_session(ts: Column, zone: Column | str, close_minute: Column | int) -> Column:
    """The last session that is over at ``ts``: days back from the local date, by its weekday and whether its session is over."""
    local = local_time(ts, zone)
    over, day = F.hour(local) * 60 + F.minute(local) >= close_minute, F.weekday(local)
    back = F.when(day >= 5, day - 4).when(over, 0).when(day == 0, 3).otherwise(1)
    return F.date_sub(F.to_date(local), back)


def settlement_session(ts: Column, zone: Column | str, close_minute: Column | int) -> Column:
    return next_session(baseline_session(ts, zone, close_minute))
