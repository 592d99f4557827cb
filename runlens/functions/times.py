"""Dates and times as column expressions (F6 to F9). The session's time zone is UTC.

Texts that are no time give NULL, and so does NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats and the fixed offset of the older interface.
DATE = "yyyy-MM-dd"
CREATION_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")
DISPLAY = "yyyy-MM-dd HH:mm:ss 'UTC'"
LEGACY_OFFSET_HOURS = 8

_OFFSET = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def parse_date(text: Column) -> Column:
    """a day written YYYY-MM-DD, and nothing else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def to_utc(text: Column) -> Column:
    """an ISO time as a timestamp; without an offset it is UTC already."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def legacy_time(text: Column) -> Column:
    """the wall clock at +08:00 as text. A time with an offset is converted, one without is only labelled."""
    shift = F.when(text.rlike(_OFFSET), F.lit(LEGACY_OFFSET_HOURS)).otherwise(F.lit(0))
    wall = to_utc(text) + F.make_interval(hours=shift)
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{LEGACY_OFFSET_HOURS:02d}:00"))


def display(time: Column) -> Column:
    """F8: a timestamp as it is shown to readers."""
    return F.date_format(time, DISPLAY)


def creation_date(text: Column, ingest_time: Column) -> Column:
    """the UTC day of creation by the two stored formats, else the day of ``ingest_time``."""
    found = [F.try_to_timestamp(text, F.lit(f)) for f in CREATION_FORMATS]
    return F.to_date(F.coalesce(*found, ingest_time))
