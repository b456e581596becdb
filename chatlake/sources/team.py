"""Team consolidation of per-user daily-summary CSV exports.

Each user exports the R16 daily summary; the files are collected in one
folder, one file per user (the file name is the user), or written there for
all users at once, a folder for each. A team map
``(team, user)`` assigns users to teams; users missing from it count
under ``unassigned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import joins_by_seen_size
from . import files

DAILY_SCHEMA = "day date, sessions long, hours double, cost double, messages long"
DAILY_COLUMNS = ("day", "sessions", "hours", "cost", "messages")
MAX_TEAM_MAP_ROWS = 1_000_000


#: Characters that names of such folders have as %XX, and the name for no user, as Spark's partition folders have them.
_ESCAPED = [chr(c) for c in (*range(1, 32), 127)] + list("\"#'*/:=?\\{[]^")
NO_USER = "__HIVE_DEFAULT_PARTITION__"


def _folder_of(user: Column) -> Column:
    out = F.replace(user, F.lit("%"), F.lit("%25"))
    for c in _ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name = F.when(user.rlike(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"), out).otherwise(user)
    return F.concat(F.lit("user="), F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_USER)))


def _user_of(folder: Column) -> Column:
    name = F.substring(folder, len("user=") + 1, 1 << 30)
    out = name
    for c in _ESCAPED:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    out = F.replace(out, F.lit("%25"), F.lit("%"))
    return F.when(name != NO_USER, F.when(name.contains("%"), out).otherwise(name))


def export_team(per_user: DataFrame, folder: str) -> None:
    """Daily summaries of many users (column ``user``) as CSV, a folder for each user
    with one file. Tasks write the files themselves, where they can open the folder."""
    spark = per_user.sparkSession
    rows = per_user.select("user", *DAILY_COLUMNS)
    with joins_by_seen_size(spark):
        if not files.reachable(folder):
            rows.repartition("user").write.mode("overwrite").option("header", True).partitionBy("user").csv(folder)
            return
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(where, True)
        fs.mkdirs(where)
        path = F.concat(_folder_of(F.col("user")), F.lit("/daily.csv"))
        # a user's first line is the header
        lines = rows.select(path.alias("path"), "day", F.to_csv(F.struct(*DAILY_COLUMNS)).alias("value"))
        nth = F.row_number().over(Window.partitionBy("path").orderBy("day"))
        lines = lines.select("path", F.when(nth == 1, F.concat(F.lit(",".join(DAILY_COLUMNS) + "\n"), "value")).otherwise(F.col("value")).alias("value"))
        files.write_lines(lines, folder)


def read_team_exports(spark: SparkSession, folder: str) -> DataFrame:
    """All exports under ``folder`` with a ``user`` column: from the folders
    that :func:`export_team` writes, else from the names of ``*.csv`` files."""
    n = own = 0
    if files.reachable(folder):
        name = F.element_at(F.split("path", "/"), -1)
        found = files.list_tree(spark, folder).filter(F.element_at(F.split("path", "/"), -2).startswith("user=") & ~name.rlike("^[._]"))
        n, own = found.agg(F.count(F.lit(1)), F.count_if(name.endswith(".csv"))).first()
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder, "user=*")
        n = len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or [])
    if n and n == own:  # in tasks: a folder for each user is much to list for the driver, and to plan
        lines = files.read_ranges(files.ranges(found.filter("file_size > 0").select(F.col("path").alias("file_path"), "file_size")))
        user = _user_of(F.element_at(F.split("file_path", "/"), -2))
        return (lines.filter("(blk > 0 OR nth > 0) AND value <> ''").select(user.alias("user"), F.from_csv("value", DAILY_SCHEMA).alias("row"))
                .select("user", *[F.col("row")[c].alias(c) for c in DAILY_COLUMNS]))
    if n:
        return (spark.read.schema(f"user string, {DAILY_SCHEMA}").option("header", True).option("basePath", folder)
                .csv(folder).select("user", *DAILY_COLUMNS))
    df = (spark.read.schema(DAILY_SCHEMA).option("header", True)
          .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(folder))
    user = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return df.select(user.alias("user"), "*")


def team_map(spark: SparkSession, teams: dict[str, list[str]]) -> DataFrame:
    rows = [(team, user) for team, users in teams.items() for user in users]
    out = spark.createDataFrame(rows, "team string, user string")
    return F.broadcast(out) if len(rows) <= MAX_TEAM_MAP_ROWS else out


def team_daily(exports: DataFrame, teams: DataFrame) -> DataFrame:
    """Per (team, day): summed sessions, hours, cost, messages and user count.

    A team map within the bound that :func:`team_map` checks is broadcast.
    """
    j = exports.join(teams, "user", "left")
    return (j.groupBy(F.coalesce("team", F.lit("unassigned")).alias("team"), "day")
            .agg(F.count_distinct("user").alias("users"),
                 F.sum("sessions").alias("sessions"),
                 F.round(F.sum("hours"), 1).alias("hours"),
                 F.round(F.sum("cost"), 2).alias("cost"),
                 F.sum("messages").alias("messages"))
            .orderBy("team", F.desc("day")))
