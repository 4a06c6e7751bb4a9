"""ISO text, timestamps and unix seconds. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted text shapes
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
# fixed values: last second a timestamp can hold (year 9999) and the unix range that counts as a date (to 2100)
LAST_SECOND = 253402300799
UNIX_RANGE_END = 4102444800


def iso_to_timestamp(text: Column) -> Column:
    """ISO date or datetime text to a timestamp; text without an offset means UTC; anything else NULL."""
    shaped = F.when(text.rlike(ISO_DATETIME) | text.rlike(ISO_DATE), text)
    return F.try_to_timestamp(F.regexp_replace(shaped, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def is_iso_datetime(text: Column) -> Column:
    """True for text that names a date and a time that exist."""
    return F.coalesce(text.rlike(ISO_DATETIME) & iso_to_timestamp(text).isNotNull(), F.lit(False))


def timestamp_to_iso(ts: Column) -> Column:
    """UTC ISO text ending in Z, with microseconds only where they are not zero."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def unix_to_timestamp(seconds: Column) -> Column:
    """Non-negative unix seconds to a timestamp; negative or out of range is NULL."""
    return F.when((seconds >= 0) & (seconds < LAST_SECOND + 1), F.timestamp_seconds(seconds))


def timestamp_to_unix(ts: Column) -> Column:
    """Whole unix seconds, cut towards zero."""
    micros = F.unix_micros(ts)
    cut = F.abs(micros) - F.abs(micros) % 1_000_000
    return (F.signum(micros).cast("long") * (cut / 1_000_000).cast("long")).cast("long")


def is_unix_timestamp(number: Column) -> Column:
    return F.coalesce(number.between(0, UNIX_RANGE_END), F.lit(False))
