"""F8: slash-command and skill invocations inside user message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

# Fixed patterns (must match the reference's to find the same commands).
COMMAND_MESSAGE_PATTERN = r"<command-message>([^<]+)</command-message>"
COMMAND_ARGS_PATTERN = r"<command-args>([^<]*)</command-args>"
COMMAND_NAME_PATTERN = r"<command-name>/([^<]+)</command-name>"


def command_invocation(text) -> Column:
    """struct<command_name, command_args, is_skill>, NULL when there is none.

    The ``<command-message>`` form wins; its arguments are NULL when the
    args tag is missing and '' when it is empty. The ``<command-name>/x``
    form has NULL arguments. A name with ':' is a skill.
    """
    t = col(text)
    has_msg = t.rlike(COMMAND_MESSAGE_PATTERN)
    has_name = t.rlike(COMMAND_NAME_PATTERN)
    name = (F.when(has_msg, strip(F.regexp_extract(t, COMMAND_MESSAGE_PATTERN, 1)))
            .when(has_name, strip(F.regexp_extract(t, COMMAND_NAME_PATTERN, 1))))
    args = F.when(has_msg & t.rlike(COMMAND_ARGS_PATTERN),
                  strip(F.regexp_extract(t, COMMAND_ARGS_PATTERN, 1)))
    found = F.struct(name.alias("command_name"), args.alias("command_args"),
                     name.contains(":").alias("is_skill"))
    # Cheap substring test first: most messages carry no command tags.
    return F.when(t.contains("<command-") & (has_msg | has_name), found)
