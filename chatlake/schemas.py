"""Schemas: the line contract, the JSON parse schemas and the 8 output tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = (T.StringType(), T.LongType(), T.IntegerType(),
                     T.DoubleType(), T.BooleanType(), T.TimestampType())


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---------------------------------------------------------------------------
# Line contract: every source (disk scan or synthesised corpus) produces this.
# ``load_rank`` orders files like the reference's processing order
# (code files before cowork files, then by path) for W3/W4/W5.
# ---------------------------------------------------------------------------
LINES = struct(
    ("source", S), ("file_path", S), ("session_id", S), ("is_agent", B),
    ("project_dir_name", S), ("project_path", S), ("file_size", L),
    ("file_mtime", TS), ("load_rank", I), ("line_num", L), ("value", S),
)
FILE_COLS = ["source", "file_path", "session_id", "is_agent", "project_dir_name",
             "project_path", "file_size", "file_mtime", "load_rank"]

# ---------------------------------------------------------------------------
# JSON parse schemas. Polymorphic or numeric fields are read as STRING and
# cast with try_* functions: a type mismatch inside from_json turns the whole
# record corrupt, and ANSI casts would fail the job on bad input.
# ---------------------------------------------------------------------------
# JSON as RFC 8259 has it, without the reader's own limits on the length of
# strings and numbers and on nesting, and without quotes that are not JSON's.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1), "maxNestingDepth": str(2**31 - 1),
              "allowSingleQuotes": "false"}
ENVELOPE_DDL = (
    "type string, timestamp string, uuid string, parentUuid string, "
    "isSidechain string, gitBranch string, cwd string, version string, "
    "slug string, agentId string, subtype string, durationMs string, "
    "message struct<role string, model string, id string, stop_reason string, "
    "usage string>, _corrupt_record string"
)
# Second parse of user/assistant lines: content as typed blocks. It fails
# (NULL) for string content and for arrays holding a non-object element.
CONTENT_BLOCKS_DDL = (
    "message struct<content array<struct<type string, text string, thinking string, "
    "id string, name string, input string, tool_use_id string, is_error string, "
    "content variant>>>"
)
CONTENT_STRING_DDL = "message struct<content string>"
# Fallback for arrays the typed read rejects: elements kept as raw JSON.
CONTENT_ARRAY_DDL = "message struct<content array<string>>"
# Last: JSON nested beyond 1,000 levels is read, but not copied as text. Of a
# tool's input these blocks have the fields that the tables use.
CONTENT_DEEP_DDL = CONTENT_BLOCKS_DDL.replace("input string", "input struct<file_path string, path string, "
                                              "notebook_path string, command string, description string>")
BLOCK_DDL = (
    "type string, text string, thinking string, id string, name string, "
    "input string, tool_use_id string, is_error string, content string"
)
RESULT_ITEMS_DDL = "content array<struct<type string, text string>>"
TOOL_INPUT_DDL = ("file_path string, path string, notebook_path string, "
                  "command string, description string")
USAGE_DDL = ("input_tokens string, output_tokens string, "
             "cache_creation_input_tokens string, cache_read_input_tokens string, "
             "service_tier string, inference_geo string")
SIDECAR_DDL = (
    "sessionId string, title string, initialMessage string, model string, "
    "createdAt string, lastActivityAt string, vmProcessName string, "
    "userSelectedFolders array<string>, isArchived string, _corrupt_record string"
)

# ---------------------------------------------------------------------------
# Names, order and types of the output tables' columns.
# ---------------------------------------------------------------------------
SESSIONS = struct(
    ("session_id", S), ("project_path", S), ("project_dir_name", S),
    ("started_at", TS), ("ended_at", TS), ("duration_seconds", I),
    ("git_branch", S), ("cwd", S), ("claude_version", S), ("model", S),
    ("slug", S), ("agent_id", S),
    ("user_message_count", I), ("assistant_message_count", I),
    ("tool_call_count", I), ("command_count", I), ("is_agent", B), ("source", S),
    ("total_input_tokens", L), ("total_output_tokens", L),
    ("total_cache_creation_tokens", L), ("total_cache_read_tokens", L),
    ("cache_hit_rate", D), ("estimated_input_cost_usd", D),
    ("estimated_output_cost_usd", D), ("estimated_total_cost_usd", D),
    ("total_turn_duration_ms", L), ("avg_turn_duration_ms", D), ("turn_count", I),
    ("file_size_bytes", L), ("file_path", S), ("extracted_at", TS),
    ("jsonl_modified_at", TS),
)
MESSAGES = struct(
    ("message_id", S), ("session_id", S), ("parent_uuid", S), ("role", S),
    ("timestamp", TS), ("sequence_number", I), ("content_text", S),
    ("has_thinking", B), ("thinking_text", S), ("stop_reason", S), ("model", S),
    ("api_message_id", S), ("is_sidechain", B), ("cwd", S), ("git_branch", S),
    ("input_tokens", I), ("output_tokens", I), ("cache_creation_input_tokens", I),
    ("cache_read_input_tokens", I), ("service_tier", S), ("inference_geo", S),
)
TOOL_CALLS = struct(
    ("tool_call_id", S), ("message_id", S), ("session_id", S), ("tool_name", S),
    ("input_summary", S), ("timestamp", TS), ("file_path", S), ("command", S),
    ("description", S), ("result_message_id", S), ("has_error", B),
)
COMMAND_INVOCATIONS = struct(
    ("session_id", S), ("message_id", S), ("timestamp", TS),
    ("command_name", S), ("command_args", S), ("is_skill", B),
)
FILES_REFERENCED = struct(
    ("session_id", S), ("file_path", S), ("operation", S),
    ("first_referenced_at", TS), ("reference_count", I),
)
MODEL_USAGE = struct(
    ("session_id", S), ("model", S), ("message_count", I),
    ("total_input_tokens", L), ("total_output_tokens", L),
    ("total_cache_creation_tokens", L), ("total_cache_read_tokens", L),
)
ETL_STATE = struct(
    ("file_path", S), ("session_id", S), ("file_size_bytes", L),
    ("file_modified_at", TS), ("extracted_at", TS), ("batch_id", S),
    ("is_loser", B),
)
COWORK_SESSIONS = struct(
    ("cowork_session_id", S), ("jsonl_session_id", S), ("title", S),
    ("initial_message", S), ("model", S), ("created_at", TS),
    ("last_activity_at", TS), ("vm_process_name", S),
    ("user_selected_folders", T.ArrayType(S)), ("is_archived", B),
)
QUARANTINE = struct(("file_path", S), ("session_id", S), ("line_num", L),
                    ("reason", S), ("value", S))

TABLES = {
    "sessions": SESSIONS, "messages": MESSAGES, "tool_calls": TOOL_CALLS,
    "command_invocations": COMMAND_INVOCATIONS,
    "files_referenced": FILES_REFERENCED, "model_usage": MODEL_USAGE,
    "cowork_sessions": COWORK_SESSIONS, "etl_state": ETL_STATE,
}
# Natural keys (the reference's PRIMARY KEY / UNIQUE constraints).
TABLE_KEYS = {
    "sessions": ["session_id"],
    "messages": ["session_id", "message_id"],
    "tool_calls": ["tool_call_id"],
    "command_invocations": ["session_id", "message_id", "command_name"],
    "files_referenced": ["session_id", "file_path", "operation"],
    "model_usage": ["session_id", "model"],
    "cowork_sessions": ["cowork_session_id"],
    "etl_state": ["file_path"],
}
# Tables whose rows belong to one session (replaced whole when it is re-read).
SESSION_TABLES = ["sessions", "messages", "tool_calls", "command_invocations",
                  "files_referenced", "model_usage"]
