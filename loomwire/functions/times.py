"""Column functions on publication times. Instants are TIMESTAMPs in UTC; whether a text named an offset is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.text import full

BUCKET_SECONDS = 6 * 3600
_OFFSET = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def has_offset(raw: Column) -> Column:
    return F.trim(full(raw)).rlike(r"\d[T ]\d.*" + _OFFSET[4:]) | F.trim(full(raw)).rlike(r"(?i)\dZ$")


def parse_time(raw: Column) -> Column:
    """ISO texts and the forms ``2024-01-31 [10:11:12]`` and ``2024/01/31 [10:11:12]``; without offset they are UTC, and
    what cannot be read is null."""
    t = F.replace(F.trim(full(raw)), F.lit("/"), F.lit("-"))
    iso = F.regexp_replace(t, "(?i)z$", "+00:00")
    looks = iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$")
    return F.when(looks, F.try_to_timestamp(F.replace(iso, F.lit(" "), F.lit("T"))))


def published_raw(raw: Column) -> Column:
    return F.nullif(F.trim(full(raw)), F.lit(""))


def within_days(a: Column, a_offset: Column, b: Column, b_offset: Column, days: int) -> Column:
    """At most ``days`` apart, both known, and both with or both without an offset."""
    gap = F.abs(F.unix_micros(a) - F.unix_micros(b))
    return F.coalesce((gap <= days * 86_400 * 1_000_000) & a_offset.eqNullSafe(b_offset), F.lit(False))


def time_bucket(ts: Column, run_ts: Column) -> Column:
    """The six hours that hold ``ts``, or the run's time where it is missing."""
    seconds = F.unix_seconds(F.coalesce(ts, run_ts))
    return F.timestamp_seconds(F.floor(seconds / BUCKET_SECONDS) * BUCKET_SECONDS)


def bucket_score(a: Column, b: Column) -> Column:
    hours = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3_600_000_000
    return F.when(hours <= 12, 1.0).when(hours <= 36, 0.75).when(hours <= 72, 0.45).otherwise(0.0)


def display_time(ts: Column, style: str = "short") -> Column:
    """A time as the feed shows it in China: ``1/31 18:05`` or ``2024年1月31日 18:05``."""
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    return full(F.date_format(local, "M/d HH:mm" if style == "short" else "yyyy年M月d日 HH:mm"))
