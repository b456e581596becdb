"""Small string expressions used by the parse stage (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
TRUNCATION_SUFFIX = "... [truncated]"
MAX_CONTENT_TEXT = 50000      # messages.content_text, messages.thinking_text
MAX_INPUT_SUMMARY = 2000      # tool_calls.input_summary
MAX_COMMAND = 1000            # tool_calls.command
MAX_COMMAND_ARGS = 500        # command_invocations.command_args
MAX_INITIAL_MESSAGE = 5000    # cowork_sessions.initial_message (plain cut)
MAX_TOOL_RESULT_SNIPPET = 200  # "[tool_result: ...]" snippets (plain cut)
# Absolute paths inside a Bash command: start of text or after whitespace,
# then "/" and everything up to whitespace or one of ; | & >.
BASH_PATH_PATTERN = r"(?U)(?:^|\s)(/[^\s;|&>]+)"
# Unicode whitespace at either end (Python's str.strip()).
STRIP_PATTERN = r"(?U)^\s+|\s+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(c, n: int) -> Column:
    """first ``n`` characters plus a marker when longer (result may be n+15)."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(TRUNCATION_SUFFIX))).otherwise(c)


def strip(c) -> Column:
    """remove Unicode whitespace at both ends (Spark's trim only strips spaces)."""
    return F.regexp_replace(col(c), STRIP_PATTERN, "")


def nonempty(c) -> Column:
    """Python truthiness for an optional string: '' and NULL are both absent."""
    return F.nullif(col(c), F.lit(""))


def json_truthy(raw) -> Column:
    """Truthiness of a JSON value read as raw text (false/0/''/[]/{}/null are false)."""
    raw = col(raw)
    return raw.isNotNull() & ~raw.isin("false", "0", "0.0", "", "[]", "{}")


def bash_paths(command) -> Column:
    """absolute paths found in a shell command whose last segment has a dot."""
    found = F.regexp_extract_all(col(command), F.lit(BASH_PATH_PATTERN), 1)
    return F.filter(found, lambda p: F.element_at(F.split(p, "/"), -1).contains("."))
