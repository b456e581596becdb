"""Transcript files on any Hadoop file system -> the LINES contract.

Code folders and cowork trees are listed in tasks, level by level
(:mod:`chatlake.sources.files`), and chosen files are read as byte ranges in
tasks, so unchanged files are never opened (J3 runs first) and no path passes
the driver. Where only Hadoop's API opens a file system, Spark's own file index
(``binaryFile`` with only metadata columns) and text reader take the code folders.

Line numbers (S8): a range of a file is read in order by one task, which knows
the places of its lines. The lines of a file of one range have their numbers so;
in larger files the range's offset (lines in earlier ranges of the same file, a
small table with a running sum) is added. In Spark's own scan
``monotonically_increasing_id`` orders the lines of a split in the same way. No
window ever holds a whole file, so one huge transcript does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from . import files

CODE = "claude-code"
COWORK = "cowork"
# Split tables under this many rows are broadcast to the scan (checked
# against the file count and the byte size before planning).
MAX_BROADCAST_SPLITS = 200_000


def decode_path(c) -> Column:
    """``_metadata`` paths are URIs: strip ``file:`` and undo %-encoding."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_replace(c, r"^file:(//)?", "")
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def _list(spark: SparkSession, path: str, recursive: bool = False,
          glob: str = "*.jsonl") -> DataFrame:
    empty = spark.createDataFrame([], "path string, file_size long, file_mtime timestamp")
    try:
        r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
        if recursive:
            r = r.option("recursiveFileLookup", "true")
        df = r.load(path)
    except Exception as exc:  # a glob matching nothing raises PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return empty
        raise
    return df.select(decode_path("path").alias("path"), F.col("length").alias("file_size"),
                     F.col("modificationTime").alias("file_mtime"))


def list_cowork(spark: SparkSession, cowork_dir: str) -> DataFrame:
    """Every file under ``cowork_dir`` at any depth, hidden folders included
    (path, file_size, file_mtime), for transcripts and sidecars alike.

    Spark's file index skips names starting with '.' or '_', but transcripts
    sit under ``.claude`` folders, so the tree is listed level by level in tasks.
    """
    root = cowork_dir.rstrip("/")
    return files.list_tree(spark, root) if files.reachable(root) else _list_tree(spark, root)


def _list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same by Hadoop's API on the driver, for file systems that only it can open."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(path):
        it = fs.listFiles(path, True)
        while it.hasNext():
            st = it.next()
            rows.append((st.getPath().toUri().toString(), int(st.getLen()), int(st.getModificationTime())))
    df = spark.createDataFrame(rows, "uri string, file_size long, mtime_ms long")
    return df.select(decode_path("uri").alias("path"), "file_size",
                     F.timestamp_millis("mtime_ms").alias("file_mtime"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.jsonl$", "")


def discover_code_files(spark: SparkSession, claude_dir: str) -> DataFrame:
    """``<dir>/projects/<project>/*.jsonl``, one level deep."""
    root = f"{claude_dir.rstrip('/')}/projects"
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    if files.reachable(root):
        # hidden files are left out, as Spark's file index does
        found = files.list_tree(spark, root, levels=2).filter(name.endswith(".jsonl") & ~name.startswith(".") & ~(name.startswith("_") & ~name.contains("=")))
    else:
        found = _list(spark, f"{root}/*/*.jsonl")
    return found.select(
        F.lit(CODE).alias("source"), F.col("path").alias("file_path"),
        _stem(name).alias("session_id"), name.startswith("agent-").alias("is_agent"),
        F.element_at(parts, -2).alias("project_dir_name"),
        F.lit(None).cast("string").alias("project_path"),
        "file_size", "file_mtime", F.lit(0).alias("load_rank"))


def discover_cowork_files(spark: SparkSession, cowork_dir: str, tree: DataFrame | None = None) -> DataFrame:
    """Any depth; skip ``cowork_plugins`` folders and ``audit.jsonl``.

    Adds ``cowork_dir_id`` (nearest ``local_*`` ancestor) and ``sidecar_path``.
    ``tree``: what ``list_cowork`` has found, if it ran before.
    """
    tree = list_cowork(spark, cowork_dir) if tree is None else tree
    found = tree.filter(F.col("path").endswith(".jsonl"))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    dir_path = F.regexp_replace("path", r"/[^/]*$", "")
    dir_parts = F.split(dir_path, "/")
    local = F.regexp_extract(dir_path, r"^(.*/)(local_[^/]*)(?:/.*)?$", 2)
    local_parent = F.regexp_extract(dir_path, r"^(.*/)(local_[^/]*)(?:/.*)?$", 1)
    proj = F.regexp_extract(dir_path, r"/\.claude/projects/([^/]+)", 1)
    out = found.filter(~F.array_contains(dir_parts, "cowork_plugins") & (name != "audit.jsonl"))
    return out.select(
        F.lit(COWORK).alias("source"), F.col("path").alias("file_path"),
        _stem(name).alias("session_id"), name.startswith("agent-").alias("is_agent"),
        F.coalesce(F.nullif(proj, F.lit("")), F.lit("cowork")).alias("project_dir_name"),
        F.lit(None).cast("string").alias("project_path"),
        "file_size", "file_mtime", F.lit(1).alias("load_rank"),
        F.nullif(local, F.lit("")).alias("cowork_dir_id"),
        F.when(local != "", F.concat(local_parent, local, F.lit(".json"))).alias("sidecar_path"))


def read_sidecars(spark: SparkSession, cowork_dir: str, tree: DataFrame | None = None) -> DataFrame:
    """S3: every ``local_*.json`` under the cowork folder, as whole text. ``tree`` as above."""
    tree = list_cowork(spark, cowork_dir) if tree is None else tree
    found = tree.filter(F.col("path").rlike(r"/local_[^/]*\.json$"))
    if files.reachable(cowork_dir):
        return files.read_whole(found).select(F.col("path").alias("sidecar_path"), F.col("text").alias("sidecar_text"))
    names = [r[0] for r in found.select("path").collect()]
    if not names:
        return spark.createDataFrame([], "sidecar_path string, sidecar_text string")
    df = spark.read.option("wholetext", "true").text([_glob_escape(p) for p in names])
    return df.select(decode_path(F.col("_metadata.file_path")).alias("sidecar_path"),
                     F.col("value").alias("sidecar_text"))


def read_all_code_lines(spark: SparkSession, chosen: DataFrame, claude_dir: str,
                        max_broadcast_splits: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """S8 for a full run over code transcripts that only Hadoop's API can open: the
    folders are read by their pattern and joined to ``chosen``."""
    n = chosen.count()
    if not n:
        return spark.createDataFrame([], schemas.LINES)
    try:
        text = spark.read.option("ignoreMissingFiles", "true").text(f"{claude_dir.rstrip('/')}/projects/*/*.jsonl")
    except Exception as exc:  # all files went after they were listed
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schemas.LINES)
        raise
    return _numbered(spark, _scanned(text), chosen, n, max_broadcast_splits)


def read_lines(spark: SparkSession, chosen: DataFrame, paths: list[str] | None = None,
               max_broadcast_splits: int = MAX_BROADCAST_SPLITS, root: str = "/", range_bytes: int = files.RANGE_BYTES) -> DataFrame:
    """The lines of the ``chosen`` files (FILE_COLS), with 0-based line numbers.

    The table of chosen files is all that is needed: each is cut into byte
    ranges, which tasks read. Files that went meanwhile are left out. With a list
    of ``paths``, or where only Hadoop's API opens the file system of ``root``,
    Spark's own reader takes these.
    """
    if paths is None and files.reachable(root):
        return _read_in_ranges(chosen.select(*schemas.FILE_COLS).filter("file_size > 0"), range_bytes, max_broadcast_splits)
    paths = [r[0] for r in chosen.select("file_path").collect()] if paths is None else paths
    # only here a missing file is left out: it went after it was listed
    paths = _there(spark, paths)
    if not paths:
        return spark.createDataFrame([], schemas.LINES)
    text = spark.read.option("ignoreMissingFiles", "true").text([_glob_escape(p) for p in paths])
    return _numbered(spark, _scanned(text), chosen, len(paths), max_broadcast_splits)


def _read_in_ranges(chosen: DataFrame, range_bytes: int, max_broadcast_splits: int) -> DataFrame:
    """The numbered lines of the files. Each line comes with the columns of its file, so no line is joined to a table of files."""
    lines, line_num = files.read_ranges(files.ranges(chosen, range_bytes)), F.col("nth")
    large = files.ranges(chosen.filter(F.col("file_size") > range_bytes).select("file_path", "file_size"), range_bytes)
    n = large.count()
    if n:
        # only files of several ranges have lines before a range: these are counted
        counts = files.read_ranges(large).groupBy("file_path", "blk").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("file_path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("file_path", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
        lines = lines.join(F.broadcast(offsets) if n <= max_broadcast_splits else offsets, ["file_path", "blk"], "left")
        line_num = F.coalesce("off", F.lit(0)) + line_num
    return lines.withColumn("line_num", line_num).select(*[F.col(f.name).cast(f.dataType) for f in schemas.LINES.fields])


def _scanned(text: DataFrame) -> DataFrame:
    """A scan's lines with their file, split and place among the lines of the split."""
    return text.select(
        "value", decode_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"))


def _numbered(spark: SparkSession, raw: DataFrame, files: DataFrame, n_files: int, max_broadcast_splits: int) -> DataFrame:
    """The lines of ``files`` (``n_files`` of them) with their numbers."""
    splits = raw.groupBy("file_path", "blk").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file_path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file_path", "blk", "first",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    max_bytes = _bytes_conf(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    est_splits = n_files + _total_bytes(files) // max(max_bytes, 1)
    if est_splits <= max_broadcast_splits:
        offsets = F.broadcast(offsets)
    lines = raw.join(offsets, ["file_path", "blk"]).select(
        "file_path", (F.col("off") + F.col("mid") - F.col("first")).alias("line_num"), "value")
    meta = files.select(*schemas.FILE_COLS)
    return lines.join(F.broadcast(meta) if n_files <= max_broadcast_splits else meta, "file_path") \
        .select(*[F.col(f.name).cast(f.dataType) for f in schemas.LINES.fields])


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the files that are still there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def _total_bytes(files: DataFrame) -> int:
    row = files.agg(F.sum("file_size")).first()
    return int(row[0] or 0)


def _bytes_conf(v: str) -> int:
    v = v.strip().lower().rstrip("b")
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    if v and v[-1] in mult:
        return int(float(v[:-1]) * mult[v[-1]])
    return int(v)


def _glob_escape(path: str) -> str:
    """Explicit file paths are globbed by the reader: escape glob characters."""
    out = []
    for ch in path:
        out.append("\\" + ch if ch in "[]{}*?\\" else ch)
    return "".join(out)
