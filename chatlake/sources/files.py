"""Files of a tree listed and read in tasks: no list of paths on the driver.

Folders are rows. Tasks list them and walk on into their subfolders, within a
bound; the folders left are the rows of the next job, so a tree of any width
takes at most as many jobs as it is deep, and many small trees take two or three. Chosen files
are cut into byte ranges, also rows; a task reads the lines that begin in its
range, so one large file is read by many tasks.

Tasks open files with ``pyarrow.fs`` (local folders, HDFS, S3, GCS). Hidden
folders are listed like others. What went between listing and reading is left
out. :func:`reachable` tells whether a folder's file system is one of these.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Bytes of a range, and bytes that a task reads before it passes lines on.
RANGE_BYTES, STEP_BYTES = 64 << 20, 8 << 20
#: Names of a listing that a task passes on at once, ranges that a task reads at most (on average), rows of a batch of lines.
STEP_NAMES, TASK_RANGES, STEP_LINES = 4096, 2048, 4096
#: Folders that a task lists (on average), and names after which it walks no further into subfolders.
TASK_FOLDERS, WALK_NAMES = 128, 1024
#: Bytes up to which a file is read at once.
SMALL_BYTES = 1 << 20
LISTED = "path string, is_dir boolean, file_size long, file_mtime timestamp"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def reachable(root: str) -> bool:
    """Whether tasks can open this folder's file system."""
    try:
        _open(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _plain(root: str) -> str:
    return root[5:] if root.startswith("file:/") and not root.startswith("file://") else root.removeprefix("file://")


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _entries(folder: str):
    """(path, is_dir, size, mtime in ns) of what is in a folder; none if it is not there."""
    fs, path = _open(folder)
    if not isinstance(fs, pafs.LocalFileSystem):
        for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            yield f"{folder}/{i.base_name}", i.type == pafs.FileType.Directory, i.size or 0, i.mtime_ns or 0
        return
    try:
        # one entry at a time: a folder may hold millions of files
        with os.scandir(path) as found:
            for e in found:
                try:
                    st = e.stat()
                    yield f"{folder}/{e.name}", e.is_dir(), st.st_size, st.st_mtime_ns
                except FileNotFoundError:
                    continue  # it went meanwhile
    except FileNotFoundError:
        return


def _children(batches, names: int = 0):
    """(path, is_dir, file_size, file_mtime) of what is in each folder.

    Until so many ``names`` are found, subfolders are listed too, in place of their rows."""
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                          names=["path", "is_dir", "file_size", "file_mtime"])

    rows = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            inner = [folder]
            while inner:
                for path, is_dir, size, ns in _entries(inner.pop()):
                    names -= 1
                    if is_dir and names > 0:
                        inner.append(path)
                        continue
                    rows.append((path, is_dir, size, ns // 1_000_000 * 1000))  # in whole milliseconds, like Hadoop's
                    if len(rows) == STEP_NAMES:
                        yield batch_of(rows)
                        rows = []
                if names <= 0:  # the next job goes on with these
                    rows += [(path, True, 0, 0) for path in inner]
                    inner = []
    yield batch_of(rows)


def _trees(batches):
    return _children(batches, WALK_NAMES)


def list_tree(spark: SparkSession, root: str, levels: int | None = None) -> DataFrame:
    """path, file_size, file_mtime of every file under ``root``; none if it is not there.

    At any depth, or those in the folder at depth ``levels`` alone (1: in ``root`` itself)."""
    ship_package(spark)
    level = spark.createDataFrame([(_plain(root.rstrip("/")),)], "path string")
    files, n, depth = None, 1, 0
    while n:
        # hashed, so that the folders of a large parent are listed by many tasks, and few folders each by one
        tasks = min(max(min(n, 32), -(-n // TASK_FOLDERS)), 4096)
        found = _written(level.repartition(tasks, "path").mapInArrow(_trees if levels is None else _children, LISTED), "listing")
        here, depth = found.filter("not is_dir").drop("is_dir"), depth + 1
        if depth == levels:
            return here
        files = here if files is None else files.unionByName(here)
        level = found.filter("is_dir").select("path")
        n = level.count()
    return files if levels is None else files.limit(0)


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """The columns of the files (file_path, file_size, …), and blk (first byte) and upto of each of their byte ranges."""
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("file_size") - 1, F.lit(0)), F.lit(size).cast("long"))
    return files.select("*", F.explode(begins).alias("blk")).withColumn(
        "upto", F.when(F.col("blk") + size < F.col("file_size"), F.col("blk") + size).otherwise(F.col("file_size")))


def _chunks(f, begin: int, upto: int):
    """The bytes of the lines that begin in [begin, upto), in pieces that end with a line."""
    f.seek(max(0, begin - 1))
    before = f.read(1) if begin else b"\n"
    rest, at = b"", begin
    if before == b"\r":  # of \r\n the second character is no line
        c = f.read(1)
        rest, at = (b"", begin + 1) if c == b"\n" else (c, begin)
    elif before != b"\n":
        # the line that goes on here began before: to its end
        while True:
            piece = f.read(min(STEP_BYTES, 1 << 16))
            if not piece:
                return
            k = min((x for x in (piece.find(b"\n"), piece.find(b"\r")) if x >= 0), default=-1)
            if k < 0:
                at += len(piece)
                continue
            if piece[k:k + 1] == b"\r" and k + 1 == len(piece):
                piece += f.read(1)
            k += 2 if piece[k:k + 2] == b"\r\n" else 1
            at += k
            rest = piece[k:]
            break
    # ``at``: place of the first byte of ``rest``
    while True:
        if at >= upto:
            return
        if len(rest) < upto - at:
            piece = f.read(min(STEP_BYTES, upto - at - len(rest)))
            if piece:
                rest += piece
                # only whole lines go on; \r at the end may be half a line break
                k = max(rest.rfind(b"\n"), rest.rfind(b"\r", 0, len(rest) - 1)) + 1
                if k:
                    yield rest[:k]
                    rest, at = rest[k:], at + k
                continue
            yield rest
            return
        # the last line of the range ends beyond it
        piece = f.read(1 << 16)
        more = rest + piece
        cut = _line_end(more, upto - at)
        while cut < 0 and piece:
            piece = f.read(STEP_BYTES)
            start, more = max(len(more) - 1, upto - at), more + piece
            cut = _line_end(more, start)
        yield more[:cut] if cut >= 0 else more
        return


def _line_end(data: bytes, upto: int) -> int:
    """The end of the line that the byte before ``upto`` is in, -1 if it is not in ``data``."""
    last = data[upto - 1:upto]
    if last == b"\n":
        return upto
    if last == b"\r":
        return upto + 1 if data[upto:upto + 1] == b"\n" else upto
    n, r = data.find(b"\n", upto), data.find(b"\r", upto)
    if r >= 0 and (n < 0 or r < n):
        if r + 1 == len(data):
            return -1
        return r + 2 if data[r + 1:r + 2] == b"\n" else r + 1
    return n + 1 if n >= 0 else -1


def _lines_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lines of ``data``, without their ends (\n, \r\n or \r), and the place of each one's end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    feed, back = raw == 10, raw == 13
    pair = back & np.append(feed[1:], False)  # \r of \r\n
    stop = np.flatnonzero((feed & ~np.append(False, pair[:-1])) | back)
    if len(raw) and not (feed[-1] or back[-1]):  # the last line has no end
        stop = np.append(stop, len(raw))
    ends = feed | back
    offsets = np.append(0, stop - np.searchsorted(np.flatnonzero(ends), stop)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~ends])]), stop


def split_lines(data: bytes) -> pa.Array:
    """The lines of ``data``, without their ends (\n, \r\n or \r)."""
    return _lines_of(data)[0]


def _pieces(path: str, begin: int, upto: int):
    """As :func:`_chunks`, of the file at ``path``; a small one at once. None if it went after it was listed."""
    fs, inner = _open(path)
    try:
        f = fs.open_input_file(inner)
    except FileNotFoundError:
        return
    with f:
        if begin == 0 and upto <= SMALL_BYTES:
            data = f.read(upto + 1)
            if len(data) <= upto:
                if data:
                    yield data
                return
        # large, or it grew after it was listed
        yield from _chunks(f, begin, upto)


def read_ranges(parts: DataFrame) -> DataFrame:
    """The columns of the ranges but upto, and nth (from 0, in its range) and value of each of their lines."""
    at = [parts.columns.index(c) for c in ("file_path", "blk", "upto")]
    keep = [c for c in parts.columns if c != "upto"]

    def run(batches):
        for batch in batches:
            kept = [batch.column(parts_at) for parts_at in keep_at]
            row, held, texts, last, n = [], 0, [], -1, 0

            def lines():
                # all pieces are split at once: a file of a few lines costs little more than to open it
                nonlocal last, n
                values, stop = _lines_of(b"".join(texts))
                counts = np.bincount(np.searchsorted(np.cumsum([len(t) for t in texts]), stop, side="right"), minlength=len(texts))
                first = []  # the number of each piece's first line
                for k, count in zip(row, counts.tolist()):
                    n = n if k == last else 0
                    first.append(n)
                    last, n = k, n + count
                nth = np.arange(len(stop)) + np.repeat(np.array(first) - (np.cumsum(counts) - counts), counts)
                of = pa.array(np.repeat(row, counts))
                return pa.RecordBatch.from_arrays([c.take(of) for c in kept] + [pa.array(nth), values], names=[*keep, "nth", "value"])

            for k, (path, begin, upto) in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                for data in _pieces(path, begin, upto):
                    if not data:
                        continue
                    row.append(k)
                    # each piece ends with a line, so that none goes on in the next one
                    texts.append(data if data.endswith(b"\n") else data + b"\n")
                    held += len(data) + (data.count(b"\n") + data.count(b"\r")) * (STEP_BYTES // STEP_LINES)
                    if held >= STEP_BYTES:
                        yield lines()
                        row, texts, held = [], [], 0
            if row:
                yield lines()

    ship_package(parts.sparkSession)
    keep_at = [parts.columns.index(c) for c in keep]
    total, n = parts.agg(F.coalesce(F.sum(F.col("upto") - F.col("blk")), F.lit(0)), F.count(F.lit(1))).first()
    tasks = min(max(1, -(-total // RANGE_BYTES), -(-n // TASK_RANGES)), 100_000)
    schema = parts.select(*keep).schema.add("nth", "long").add("value", "binary")
    return (parts.repartition(int(tasks), "file_path", "blk").mapInArrow(run, schema)
            .withColumn("value", F.col("value").cast("string")))


def read_whole(files: DataFrame) -> DataFrame:
    """path and text of each file (a few kilobytes each)."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _open(path)
                try:
                    with fs.open_input_file(inner) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "text"])

    return (files.select("path").repartition(int(min(max(1, -(-files.count() // 256)), 10_000)), "path")
            .mapInArrow(run, "path string, text binary").withColumn("text", F.col("text").cast("string")))


def write_lines(rows: DataFrame, root: str) -> int:
    """Files under ``root`` from their lines (path below it, value); returns their number.

    All lines of a file are beside each other in one task, in order. A file is one stream,
    written a line at a time; a task that runs again puts the same files in place."""
    def write(batches):
        fs, top = _open(root.rstrip("/"))
        own, at, out, made = None, None, None, set()
        for batch in batches:
            written = []
            for p, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != at:
                    if out is not None:
                        out.close()
                        fs.move(own, f"{top}/{at}")
                        written.append(at)
                    at, own = p, f"{top}/{p}.{uuid.uuid4().hex}"
                    folder = own.rpartition("/")[0]
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = fs.open_output_stream(own)
                out.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"path": pa.array(written, pa.string())})
        if out is not None:
            out.close()
            fs.move(own, f"{top}/{at}")
            yield pa.RecordBatch.from_pydict({"path": [at]})

    ship_package(rows.sparkSession)
    return rows.select("path", "value").mapInArrow(write, "path string").agg(F.count("path")).first()[0]


def remove(files: DataFrame) -> None:
    """Deletes the files (file_path), in tasks; those that are gone are left out."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _open(path)
                try:
                    fs.delete_file(inner)
                except FileNotFoundError:
                    continue
            yield batch.slice(0, 0)

    ship_package(files.sparkSession)
    files.select("file_path").mapInArrow(run, "file_path string").count()
