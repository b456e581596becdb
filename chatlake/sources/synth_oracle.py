"""The corpus of :mod:`chatlake.sources.synth` stated directly in SQL.

DuckDB computes the expected tables straight from the driver's Parquet
tables, without any JSON: ``ORACLE_TABLES`` is a WITH prelude defining
``o_sessions``, ``o_messages``, ``o_tool_calls``, ``o_commands``,
``o_files``, ``o_model_usage`` and ``o_cowork`` with the same columns and
types as the Spark tables. Reports are plain SQL over those names.
"""

from __future__ import annotations

_MSG = "role IN ('user', 'assistant')"

ORACLE_TABLES = f"""
WITH
prices AS (
  SELECT price_model, CAST(pi AS DOUBLE) AS pi, CAST(po AS DOUBLE) AS po,
         CAST(pcr AS DOUBLE) AS pcr, CAST(pcc AS DOUBLE) AS pcc
  FROM (VALUES ('model-0', 15.00, 75.00, 1.50, 18.75),
               ('model-1', 3.00, 15.00, 0.30, 3.75),
               ('model-2', 0.80, 4.00, 0.08, 1.00)) v(price_model, pi, po, pcr, pcc)
),
c0 AS (
  SELECT conv_id AS cid, turn, role, text, CAST(length(text) AS BIGINT) AS n,
         (CASE WHEN conv_id % 10 = 0 THEN 'agent-' ELSE '' END) || 'conv-' || CAST(conv_id AS VARCHAR) AS sid,
         CAST(1704067200 + conv_id * 1800 + turn * 45 AS BIGINT) AS ts_sec
  FROM conversations
),
cl AS (
  SELECT sid,
    CASE WHEN cid % 4 = 3 THEN 'cowork' ELSE 'claude-code' END AS source,
    (cid % 10 = 0) AS is_agent,
    '-p-' || CAST(cid % 7 AS VARCHAR) AS project_dir_name,
    '/p/' || CAST(cid % 7 AS VARCHAR) AS project_path,
    'synthetic://conversations/' || sid || '.jsonl' AS file_path,
    make_timestamp(ts_sec * 1000000) AS ts, CAST(turn AS BIGINT) AS tie,
    CASE WHEN {_MSG} THEN role END AS role,
    CASE WHEN {_MSG} THEN sid || '-m' || CAST(turn AS VARCHAR) END AS message_id,
    CASE WHEN {_MSG} AND turn > 0 THEN sid || '-m' || CAST(turn - 1 AS VARCHAR) END AS parent_uuid,
    (turn % 5 = 4) AS is_sidechain,
    CASE WHEN {_MSG} AND turn > 0 THEN 'b' || CAST(cid % 3 AS VARCHAR) END AS git_branch,
    CASE WHEN {_MSG} AND turn > 0 THEN '/p/' || CAST(cid % 7 AS VARCHAR) END AS cwd,
    CASE WHEN {_MSG} THEN '2.0.' || CAST(cid % 3 AS VARCHAR) END AS version,
    CASE WHEN {_MSG} AND cid % 10 = 0 THEN 'ag' || CAST(cid AS VARCHAR) END AS agent_id,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN 'model-' || CAST((cid + turn) % 4 AS VARCHAR) END AS model,
    CASE WHEN role = 'assistant' THEN 'msg-' || CAST(cid AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS api_message_id,
    CASE WHEN role = 'assistant' THEN 'tool_use' END AS stop_reason,
    (role = 'assistant' AND cid % 9 <> 4) AS usage_present,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN n END AS input_tokens,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN n % 101 END AS output_tokens,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN n % 7 * 10 END AS cache_creation_input_tokens,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN n % 13 * 20 END AS cache_read_input_tokens,
    CASE WHEN role = 'assistant' AND cid % 9 <> 4 THEN 'standard' END AS service_tier,
    CASE WHEN role = 'user' AND turn < 2 THEN
              (CASE WHEN cid % 5 = 0 THEN '<command-message>grp:cmd' || CAST(cid % 4 AS VARCHAR)
                    || '</command-message><command-args>' || CAST(turn AS VARCHAR) || '</command-args>'
                    ELSE '' END) || text
         WHEN role = 'user' THEN '[tool_result: ok]' || chr(10) || text
         WHEN role = 'assistant' THEN text END AS content_text,
    (role = 'assistant' AND turn % 4 = 3) AS has_thinking,
    CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN text END AS thinking_text,
    CASE WHEN role = 'assistant' THEN sid || '-m' || CAST(turn AS VARCHAR) || '-t' END AS tool_id,
    CASE WHEN role = 'assistant' THEN
         list_extract(['Read', 'Write', 'Edit', 'Grep', 'Bash', 'WebFetch'], CAST((cid + turn) % 6 + 1 AS INTEGER)) END AS tool_name,
    '/src/f' || CAST(n % 17 AS VARCHAR) || '.py' AS tool_path,
    'cat /etc/c' || CAST(n % 5 AS VARCHAR) || '.cfg | wc /tmp/x' AS tool_command,
    '{{"file_path":"/src/f' || CAST(n % 17 AS VARCHAR) || '.py","command":"cat /etc/c'
        || CAST(n % 5 AS VARCHAR) || '.cfg | wc /tmp/x"}}' AS tool_input,
    '/etc/c' || CAST(n % 5 AS VARCHAR) || '.cfg' AS bash_path,
    CASE WHEN role = 'user' AND turn >= 2 THEN sid || '-m' || CAST(turn - 1 AS VARCHAR) || '-t' END AS result_for,
    (n % 5 = 0) AS result_err,
    CASE WHEN role = 'user' AND turn < 2 AND cid % 5 = 0 THEN 'grp:cmd' || CAST(cid % 4 AS VARCHAR) END AS command_name,
    CAST(turn AS VARCHAR) AS command_args,
    CASE WHEN role = 'system' THEN n * 10 END AS dur_ms
  FROM c0
),
e0 AS (
  SELECT event_id AS eid, CAST(ts AS TIMESTAMP) AS ts, user_id AS uid, event_type, value,
         'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS sid,
         json_extract_string(props, '$.k') AS k
  FROM events
),
el AS (
  SELECT sid, 'claude-code' AS source, false AS is_agent,
    '-u-' || CAST(uid % 5 AS VARCHAR) AS project_dir_name,
    '/u/' || CAST(uid % 5 AS VARCHAR) AS project_path,
    'synthetic://events/' || sid || '.jsonl' AS file_path,
    ts, CAST(eid AS BIGINT) AS tie, 'assistant' AS role,
    'e' || CAST(eid AS VARCHAR) AS message_id, CAST(NULL AS VARCHAR) AS parent_uuid,
    false AS is_sidechain, CAST(NULL AS VARCHAR) AS git_branch,
    '/u/' || CAST(uid % 5 AS VARCHAR) AS cwd, CAST(NULL AS VARCHAR) AS version,
    CAST(NULL AS VARCHAR) AS agent_id,
    'model-' || CAST(eid % 4 AS VARCHAR) AS model,
    'msg-e' || CAST(eid AS VARCHAR) AS api_message_id, CAST(NULL AS VARCHAR) AS stop_reason,
    true AS usage_present,
    CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens,
    CAST(0 AS BIGINT) AS cache_creation_input_tokens, CAST(0 AS BIGINT) AS cache_read_input_tokens,
    CAST(NULL AS VARCHAR) AS service_tier,
    '' AS content_text, false AS has_thinking, CAST(NULL AS VARCHAR) AS thinking_text,
    'e' || CAST(eid AS VARCHAR) || '-t' AS tool_id, event_type AS tool_name,
    '/src/f' || k || '.py' AS tool_path, CAST(NULL AS VARCHAR) AS tool_command,
    '{{"file_path":"/src/f' || k || '.py"}}' AS tool_input,
    CAST(NULL AS VARCHAR) AS bash_path, CAST(NULL AS VARCHAR) AS result_for, false AS result_err,
    CAST(NULL AS VARCHAR) AS command_name, CAST(NULL AS VARCHAR) AS command_args,
    CAST(NULL AS BIGINT) AS dur_ms
  FROM e0
),
lines AS (SELECT * FROM cl UNION ALL BY NAME SELECT * FROM el),
o_roll AS (
  SELECT sid AS session_id,
    any_value(project_path) AS project_path, any_value(project_dir_name) AS project_dir_name,
    min(ts) AS started_at, max(ts) AS ended_at,
    CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS INTEGER) AS duration_seconds,
    arg_min(git_branch, ts) FILTER (WHERE git_branch <> '') AS git_branch,
    arg_min(cwd, ts) FILTER (WHERE cwd <> '') AS cwd,
    arg_min(version, ts) FILTER (WHERE version <> '') AS claude_version,
    arg_min(model, ts) FILTER (WHERE model <> '') AS model,
    CAST(NULL AS VARCHAR) AS slug,
    arg_min(agent_id, ts) FILTER (WHERE agent_id <> '') AS agent_id,
    CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS user_message_count,
    CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS assistant_message_count,
    CAST(count(tool_id) AS INTEGER) AS tool_call_count,
    CAST(count(command_name) AS INTEGER) AS command_count,
    any_value(is_agent) AS is_agent, any_value(source) AS source,
    CAST(COALESCE(sum(input_tokens) FILTER (WHERE role = 'assistant' AND usage_present), 0) AS BIGINT) AS total_input_tokens,
    CAST(COALESCE(sum(output_tokens) FILTER (WHERE role = 'assistant' AND usage_present), 0) AS BIGINT) AS total_output_tokens,
    CAST(COALESCE(sum(cache_creation_input_tokens) FILTER (WHERE role = 'assistant' AND usage_present), 0) AS BIGINT) AS total_cache_creation_tokens,
    CAST(COALESCE(sum(cache_read_input_tokens) FILTER (WHERE role = 'assistant' AND usage_present), 0) AS BIGINT) AS total_cache_read_tokens,
    COALESCE(sum(CAST(dur_ms AS DOUBLE)), 0.0) AS turn_sum,
    CAST(count(dur_ms) AS INTEGER) AS turn_count,
    any_value(file_path) AS file_path
  FROM lines GROUP BY sid
),
o_priced AS (
  SELECT r.*,
    CAST(total_input_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) * COALESCE(p.pi, CAST(3.00 AS DOUBLE)) AS c_in,
    CAST(total_output_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) * COALESCE(p.po, CAST(15.00 AS DOUBLE)) AS c_out,
    CAST(total_cache_creation_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) * COALESCE(p.pcc, CAST(3.75 AS DOUBLE)) AS c_cc,
    CAST(total_cache_read_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) * COALESCE(p.pcr, CAST(0.30 AS DOUBLE)) AS c_cr
  FROM o_roll r LEFT JOIN prices p ON COALESCE(r.model, 'unknown') = p.price_model
),
o_sessions AS (
  SELECT session_id, project_path, project_dir_name, started_at, ended_at, duration_seconds,
    git_branch, cwd, claude_version, model, slug, agent_id,
    user_message_count, assistant_message_count, tool_call_count, command_count, is_agent, source,
    total_input_tokens, total_output_tokens, total_cache_creation_tokens, total_cache_read_tokens,
    CASE WHEN total_cache_read_tokens + total_cache_creation_tokens + total_input_tokens > 0
         THEN CAST(total_cache_read_tokens AS DOUBLE)
              / CAST(total_cache_read_tokens + total_cache_creation_tokens + total_input_tokens AS DOUBLE)
    END AS cache_hit_rate,
    c_in + c_cc + c_cr AS estimated_input_cost_usd,
    c_out AS estimated_output_cost_usd,
    c_in + c_out + c_cc + c_cr AS estimated_total_cost_usd,
    CAST(turn_sum AS BIGINT) AS total_turn_duration_ms,
    CASE WHEN turn_count > 0 THEN turn_sum / turn_count END AS avg_turn_duration_ms,
    turn_count, CAST(NULL AS BIGINT) AS file_size_bytes, file_path,
    CAST(NULL AS TIMESTAMP) AS jsonl_modified_at
  FROM o_priced
),
o_messages AS (
  SELECT message_id, sid AS session_id, parent_uuid, role, ts AS "timestamp",
    CAST(row_number() OVER (PARTITION BY sid ORDER BY ts, tie) - 1 AS INTEGER) AS sequence_number,
    content_text, has_thinking, thinking_text, stop_reason, model, api_message_id, is_sidechain,
    cwd, git_branch,
    CAST(input_tokens AS INTEGER) AS input_tokens, CAST(output_tokens AS INTEGER) AS output_tokens,
    CAST(cache_creation_input_tokens AS INTEGER) AS cache_creation_input_tokens,
    CAST(cache_read_input_tokens AS INTEGER) AS cache_read_input_tokens,
    service_tier, CAST(NULL AS VARCHAR) AS inference_geo
  FROM lines WHERE role IS NOT NULL
),
o_results AS (
  SELECT sid, result_for, bool_or(result_err) AS err FROM lines WHERE result_for IS NOT NULL GROUP BY 1, 2
),
o_tool_calls AS (
  SELECT l.tool_id AS tool_call_id, l.message_id, l.sid AS session_id, l.tool_name,
    l.tool_input AS input_summary, l.ts AS "timestamp", l.tool_path AS file_path,
    l.tool_command AS command, CAST(NULL AS VARCHAR) AS description,
    CAST(NULL AS VARCHAR) AS result_message_id, COALESCE(r.err, false) AS has_error
  FROM lines l LEFT JOIN o_results r ON l.sid = r.sid AND l.tool_id = r.result_for
  WHERE l.tool_id IS NOT NULL
),
o_commands AS (
  SELECT sid AS session_id, message_id, ts AS "timestamp", command_name, command_args,
         contains(command_name, ':') AS is_skill
  FROM lines WHERE command_name IS NOT NULL
),
o_file_rows AS (
  SELECT sid, tool_path AS file_path,
    CASE WHEN lower(tool_name) IN ('read', 'write', 'edit', 'glob', 'grep', 'notebookedit')
         THEN lower(tool_name) ELSE 'other' END AS operation
  FROM lines WHERE tool_id IS NOT NULL
  UNION ALL
  SELECT sid, bash_path, 'bash' FROM lines WHERE tool_name = 'Bash'
),
o_files AS (
  SELECT f.sid AS session_id, f.file_path, f.operation, s.started_at AS first_referenced_at,
         CAST(count(*) AS INTEGER) AS reference_count
  FROM o_file_rows f LEFT JOIN o_roll s ON f.sid = s.session_id
  GROUP BY f.sid, f.file_path, f.operation, s.started_at
),
o_model_usage AS (
  SELECT sid AS session_id, COALESCE(model, 'unknown') AS model,
    CAST(count(*) AS INTEGER) AS message_count,
    CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(cache_creation_input_tokens) AS BIGINT) AS total_cache_creation_tokens,
    CAST(sum(cache_read_input_tokens) AS BIGINT) AS total_cache_read_tokens
  FROM lines WHERE role = 'assistant' AND usage_present
  GROUP BY 1, 2
),
o_cowork AS (
  SELECT 'local_' || CAST(cid AS VARCHAR) AS cowork_session_id, sid AS jsonl_session_id,
    'Task ' || CAST(cid AS VARCHAR) AS title, substr(text, 1, 5000) AS initial_message,
    'model-' || CAST(cid % 4 AS VARCHAR) AS model,
    make_timestamp((1704067200 + cid * 1800) * 1000000) AS created_at,
    make_timestamp((1704067200 + cid * 1800 + 3600) * 1000000) AS last_activity_at,
    'vm-' || CAST(cid % 5 AS VARCHAR) AS vm_process_name,
    ['/p/' || CAST(cid % 7 AS VARCHAR)] AS user_selected_folders,
    (cid % 2 = 1) AS is_archived
  FROM c0 WHERE turn = 0 AND cid % 4 = 3
)
"""


def oracle(body: str) -> str:
    """A full statement: the prelude, then ``body`` over the o_* tables."""
    return ORACLE_TABLES + body
