"""Date and time rules; the current time is always an argument."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds before the next attempt, by attempts made.
BACKOFF_SECONDS = (1, 2, 4, 8, 16, 30, 60, 120)
JITTER_SHARE = 0.25
MAX_ATTEMPTS = len(BACKOFF_SECONDS)
HOUR, DAY = 3_600, 86_400


def idle_for(last: Column, now: Column, days: int) -> Column:
    """At least ``days`` days since ``last``, the border included."""
    return F.unix_micros(now) - F.unix_micros(last) >= days * DAY * 1_000_000


def expired(valid_until: Column, now: Column) -> Column:
    """The end lies at or before ``now``; an open end never does."""
    return F.coalesce(valid_until <= now, F.lit(False))


def staleness(generated_at: Column, now: Column) -> Column:
    """``critical``, ``warning``, ``info`` or ``ok`` by age; a time to come is ``critical``."""
    age = F.unix_micros(now) - F.unix_micros(generated_at)
    at_least = lambda seconds: age >= seconds * 1_000_000
    return F.when((age < 0) | at_least(7 * DAY), "critical").when(at_least(72 * HOUR), "warning").when(at_least(24 * HOUR), "info").otherwise("ok")


def next_attempt(attempts: Column, now: Column, jitter: Column) -> Column:
    """Due time after a failure, cut to milliseconds; null once the attempts are used up."""
    base = F.get(F.array(*[F.lit(x) for x in BACKOFF_SECONDS]), attempts)
    scaled = base * (1.0 + JITTER_SHARE * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), jitter)))
    return F.timestamp_millis(F.unix_millis(now) + F.floor(scaled * 1000).cast("bigint"))


def rfc3339(text: Column) -> Column:
    """The time that an RFC 3339 text names; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(F.upper(text)))


def as_rfc3339(time: Column) -> Column:
    """RFC 3339 text in UTC (the session's zone) with as many digits of a second as the time has."""
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(time, ".SSS")).otherwise(F.date_format(time, ".SSSSSS"))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def as_of(text: Column) -> Column:
    """RFC 3339 time with any offset, or a date at midnight UTC; null for anything else."""
    full = rfc3339(text)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text))
    return F.coalesce(full, day)


def next_run(now: datetime, hour: int, minute: int, zone: str) -> datetime:
    """The next local ``hour:minute`` strictly after ``now``, in UTC."""
    local = now.astimezone(ZoneInfo(zone))
    at = local.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if at <= local:
        at = (at + timedelta(days=1)).replace(hour=hour, minute=minute)
    return at.astimezone(timezone.utc)
