"""transcript timestamps (epoch milliseconds or ISO-8601 text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Accepted ISO-8601 shapes. The guard matters: Spark's cast also accepts
# text such as '2026' or '12:00' that the reference rejects.
ISO_PATTERN = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
               r"(?:Z|[+-]\d{2}:?\d{2})?)?$")
NUMERIC_PATTERN = r"^-?[0-9][0-9.eE+-]*$"


def from_epoch_millis(ms) -> Column:
    """Epoch milliseconds (double) to a timestamp; NULL when out of range."""
    return F.timestamp_micros((col(ms) * F.lit(1000.0)).try_cast("bigint"))


def from_iso(text) -> Column:
    """ISO-8601 text (``Z`` or an offset; no offset means UTC) to a timestamp."""
    t = col(text)
    return F.when(t.rlike(ISO_PATTERN), t.try_cast("timestamp"))


def parse_timestamp(raw_text, numeric_value) -> Column:
    """``numeric_value`` is the field read as a JSON number (NULL for
    strings), ``raw_text`` the same field read as text."""
    return F.coalesce(from_epoch_millis(numeric_value), from_iso(raw_text))


def iso_text(ts) -> Column:
    """ISO-8601 text of a timestamp (used at CSV export)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
