"""Build tables from hand-written transcript lines (no disk)."""
import json

from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.functions.pricing import price_table
from chatlake.operators.parse import parse_lines
from chatlake.operators.tables import build_tables


def lines_df(spark, sessions: dict, source="claude-code", project="-p"):
    """sessions: session_id -> list of entries (dict or raw string)."""
    rows = []
    for sid, entries in sessions.items():
        for i, e in enumerate(entries):
            value = e if isinstance(e, str) else json.dumps(e)
            rows.append((source, f"/x/{project}/{sid}.jsonl", sid, sid.startswith("agent-"),
                         project, "/" + project.strip("-"), 100, None, 0, i, value))
    return spark.createDataFrame(rows, schemas.LINES)


def tables_for(spark, sessions: dict, prices=None):
    entries = parse_lines(lines_df(spark, sessions))
    return build_tables(entries, price_table(spark, prices))


def rows(df, order=None):
    if order:
        df = df.orderBy(*order)
    return [r.asDict() for r in df.collect()]
