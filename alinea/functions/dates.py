"""Dates as texts: read without failing, shown as a day, and as the text that machines exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """A timestamp from a date or time as text (year, month, day first); null where it is none, also for days that no month has."""
    return F.try_to_timestamp(F.trim(c))


def shown(ts: Column) -> Column:
    """Day, month by its short name, year: 3 Oct 1998; null stays null."""
    return F.date_format(ts, "d MMM yyyy")


def exchanged(ts: Column) -> Column:
    """With milliseconds and Z; the session's time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
