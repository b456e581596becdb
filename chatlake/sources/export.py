"""CSV export of a report (header + rows; no file for an empty result)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timestamps import iso_text

# The usual CSV form: fields in double quotes, a quote in one doubled.
CSV_FORM = {"quote": '"', "escape": '"'}


def export_csv(df: DataFrame, path: str, single_file: bool = False, compression: str | None = None) -> bool:
    """Write ``df`` as CSV with a header; returns False (and writes nothing)
    when the result is empty, as the reference does. Timestamps are written
    as ISO-8601 text, arrays as JSON text (F2, F13). Values are whole: quotes in
    them are doubled, and white space at their ends and line ends stay.

    ``single_file=True`` coalesces to one task: only for small report results.
    ``compression``: the files' codec (``gzip``), for large tables; none if it is left out.
    """
    if df.isEmpty():
        return False
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(iso_text(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(header=True, **CSV_FORM, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, compression=compression)
    return True


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported report as text columns. The form has no mark for NULL: an empty field, quoted or not, reads as NULL."""
    return spark.read.options(header=True, **CSV_FORM, multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
