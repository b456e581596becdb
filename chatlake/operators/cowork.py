"""Cowork sidecar metadata -> ``cowork_sessions`` (last write wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import MAX_INITIAL_MESSAGE, json_truthy, nonempty
from ..functions.timestamps import NUMERIC_PATTERN, parse_timestamp
from .tables import last_wins


def _sidecar_ts(meta, raw_col: str, field: str):
    raw = meta[field]
    num = F.when(raw.rlike(NUMERIC_PATTERN), F.from_json(raw_col, f"{field} double", schemas.ANY_LENGTH)[field])
    return parse_timestamp(raw, num)


def build_cowork_sessions(links: DataFrame) -> DataFrame:
    """``links``: one row per cowork transcript with a sidecar, columns
    ``cowork_dir_id`` (the ``local_*`` folder name), ``session_id``,
    ``load_rank``, ``file_path``, ``sidecar_text`` (whole JSON file).

    A sidecar that is not a JSON object, or an empty one, gives no row. The
    key is the sidecar's ``sessionId`` if it has that key at all (null or
    empty: no row), else the folder name; when several transcripts share a
    sidecar the one processed last wins.
    """
    m = F.from_json("sidecar_text", schemas.SIDECAR_DDL, {"columnNameOfCorruptRecord": "_corrupt_record", **schemas.ANY_LENGTH})
    parsed = links.withColumn("m", m)
    keys = F.json_object_keys("sidecar_text")
    ok = F.col("m").isNotNull() & F.col("m._corrupt_record").isNull() & (F.coalesce(F.array_size(keys), F.lit(0)) > 0)
    has_id = F.array_contains(keys, "sessionId")
    meta = F.col("m")
    rows = parsed.filter(ok).select(
        nonempty(F.when(has_id, meta["sessionId"]).otherwise(F.col("cowork_dir_id"))).alias("cowork_session_id"),
        F.col("session_id").alias("jsonl_session_id"),
        meta["title"].alias("title"),
        F.substring(F.coalesce(meta["initialMessage"], F.lit("")), 1, MAX_INITIAL_MESSAGE).alias("initial_message"),
        meta["model"].alias("model"),
        _sidecar_ts(meta, "sidecar_text", "createdAt").alias("created_at"),
        _sidecar_ts(meta, "sidecar_text", "lastActivityAt").alias("last_activity_at"),
        meta["vmProcessName"].alias("vm_process_name"),
        F.coalesce(meta["userSelectedFolders"], F.array().cast("array<string>")).alias("user_selected_folders"),
        F.coalesce(json_truthy(meta["isArchived"]), F.lit(False)).alias("is_archived"),
        F.struct("load_rank", "file_path").alias("_ord"),
    ).filter(F.col("cowork_session_id").isNotNull())
    return last_wins(rows, ["cowork_session_id"], "_ord", schemas.COWORK_SESSIONS)
