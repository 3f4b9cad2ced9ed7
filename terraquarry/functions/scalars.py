"""Scalar expressions: every function takes columns and returns one, within whole-stage codegen where Spark has it."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def rounded(x: Column, places: int = 6) -> Column:
    """Half up, the same in all engines: the floor form has no decimal detour."""
    return F.floor(x * F.lit(10.0**places) + F.lit(0.5)) / F.lit(10.0**places)


def parse_iso_datetime(text: Column) -> Column:
    """An instant from ISO text; Z or an offset moves it to UTC (the session's zone), null where malformed."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))


def end_of_day(day: Column) -> Column:
    """The last microsecond of a date, as an inclusive upper bound."""
    return F.date_add(day, 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND")


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def boxes_touch(a: list[Column], b: list[Column]) -> Column:
    """Closed overlap of two boxes (west, south, east, north); null corners overlap nothing."""
    return F.coalesce((a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]), F.lit(False))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; boxes that only touch, and empty unions, have 0."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when((wide > 0) & (high > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def category_of(name: Column) -> Column:
    """The class in a file name such as ``storage_tanks_12.jpg``: letters before the number, or "unknown"."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"^([a-zA-Z_]+)_\d+$", 1)
    return F.when(found == "", F.lit("unknown")).otherwise(F.lower(F.trim(F.regexp_replace(found, "_", " "))))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two float arrays, summed as doubles in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The array scaled to length 1; null for a zero vector."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))))[0]


def strict_iso_datetime(text: Column) -> Column:
    """As ``parse_iso_datetime``, but text that is missing, empty or malformed is an error."""
    found = parse_iso_datetime(text)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("Invalid ISO datetime: "), F.coalesce(text, F.lit("null")))).cast("timestamp"))


def filter_datetime(value, end_of_day: bool = False) -> datetime.datetime | None:
    """A filter's bound in UTC: None, a date (its first or last microsecond), a datetime, or ISO text of either."""
    if value is None:
        return None
    if isinstance(value, str):
        text = value.strip()
        if not text:
            raise ValueError("a date filter can't be empty")
        try:
            value = datetime.date.fromisoformat(text)
        except ValueError:
            try:
                value = datetime.datetime.fromisoformat(re.sub("[zZ]$", "+00:00", text))
            except ValueError as error:
                raise ValueError(f"invalid date or datetime {text!r}") from error
    if isinstance(value, bool) or not isinstance(value, datetime.date):
        raise TypeError(f"a date filter is a str, date or datetime, not {type(value).__name__}")
    if not isinstance(value, datetime.datetime):
        return datetime.datetime.combine(value, datetime.time.max if end_of_day else datetime.time.min, datetime.UTC)
    return value.replace(tzinfo=datetime.UTC) if value.utcoffset() is None else value.astimezone(datetime.UTC)


def file_size_text(size: Column) -> Column:
    """Bytes as text such as 598.2 MB: whole bytes, one place from KB to TB."""
    out = F.format_string("%d B", size.cast("long"))
    for power, name in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024.0**power, F.format_string(f"%.1f {name}", size / 1024.0**power)).otherwise(out)
    return out


def merged(first: Column, second: Column) -> Column:
    """The entries of two maps; of a key that both have, the second's value (also if it is null). A null map is an empty one; two null maps are null."""
    both = F.map_zip_with(F.coalesce(first, F.map_filter(second, lambda k, v: F.lit(False))), F.coalesce(second, F.map_filter(first, lambda k, v: F.lit(False))), lambda k, a, b: F.when(F.coalesce(F.map_contains_key(second, k), F.lit(False)), b).otherwise(a))
    return both
