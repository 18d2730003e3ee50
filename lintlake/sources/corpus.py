"""Source files as rows: (path, content)."""

from __future__ import annotations

import os
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.session import materialized

SUPPORTED = r"(?i)\.(" + "|".join(fv.SCAN_EXTENSIONS) + r")$"


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in ext)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1: every source file below ``root``, one row per file, paths relative to the root.

    Extensions are matched while listing, so other files are never opened.  Spark's file
    sources do not list names that begin with ``_`` or ``.``; ``read_every_file`` does.
    """
    glob = "*.{" + ",".join(_any_case(e) for e in fv.SCAN_EXTENSIONS) + "}"
    raw = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    where = F.instr(full, base)
    relative = F.when(where > 0, F.substr(full, where + F.lit(len(base)))).otherwise(full)
    return raw.select(relative.alias("path"), F.col("value").alias("content"))


def _children(batches):
    """The entries of each folder: path, whether it is a folder, and why a folder could not be listed."""
    for batch in batches:
        for folder in batch["path"]:
            try:
                store, inside = fs.FileSystem.from_uri(folder)
                found = store.get_file_info(fs.FileSelector(inside))
                if isinstance(store, fs.LocalFileSystem):  # a link to a folder may lead back here
                    found = [f for f in found if f.type != fs.FileType.Directory or not os.path.islink(f.path)]
                names = (quote(f.base_name) if "://" in folder else f.base_name for f in found)
                rows = [(f"{folder}/{name}", f.type == fs.FileType.Directory, None) for name, f in zip(names, found)]
            except OSError as e:
                rows = [(folder, False, str(e))]
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i:i + 10_000], columns=["path", "is_folder", "error"])


def _contents(batches):
    for batch in batches:
        for path, error in zip(batch["path"], batch["error"]):
            content = None
            if error is None:
                try:
                    store, inside = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(inside) as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError as e:
                    error = str(e)
            yield pd.DataFrame({"path": [path], "content": [content], "error": [error]}, dtype=object)


def read_every_file(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1 with names that begin with ``_`` or ``.``: (path, content, error), paths relative to the root.

    ``root`` is an absolute path or a URI that Arrow's file systems know.  Folders are listed
    level by level, each level by all tasks; then the files are dealt out by path and read one
    at a time.  A folder that cannot be listed or a file that cannot be read is a row with
    ``error`` and no content.  Bytes that are no UTF-8 become replacement characters.  Links to files
    are read, links to folders are not followed: every file is found once, and the walk ends.
    """
    root = root.rstrip("/")
    level = spark.createDataFrame([(root,)], "path string")
    wanted = F.col("path").rlike(SUPPORTED) | F.col("error").isNotNull()
    files = None
    while True:
        listed = materialized(level.mapInPandas(_children, "path string, is_folder boolean, error string"))
        here = listed.where(~F.col("is_folder") & wanted).select("path", "error")
        files = here if files is None else files.unionByName(here)
        level = listed.where("is_folder").select("path").repartition("path")
        if level.isEmpty():
            break
    read = files.repartition("path").mapInPandas(_contents, "path string, content string, error string")
    below = F.substr("path", F.lit(len(root) + 2))
    return read.withColumn("path", F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))) if "://" in root else below)


def supported(files: DataFrame) -> DataFrame:
    """SRC-1 on a table: keep the five source extensions, any case."""
    return files.where(F.col("path").rlike(SUPPORTED))


def drop_ignored(files: DataFrame) -> DataFrame:
    """SRC-2: leave out build output, tool folders and dependencies."""
    names = "|".join(d.replace(".", r"\.") for d in fv.IGNORED_DIRS)
    return files.where(~F.translate("path", "\\", "/").rlike(f"(^|/)({names})/"))


def glob_regex(glob: str) -> str:
    return "^(?:" + glob.replace(".", r"\.").replace("*", ".*").replace("?", ".") + ")$"


def filter_globs(files: DataFrame, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """SRC-3: an empty include list means all; an exclude wins."""
    if includes:
        files = files.where(F.col("path").rlike("|".join(glob_regex(g) for g in includes)))
    if excludes:
        files = files.where(~F.col("path").rlike("|".join(glob_regex(g) for g in excludes)))
    return files


def unix_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def file_name(c: Column) -> Column:
    return F.substring_index(unix_path(c), "/", -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(unix_path(c), r"\.([^.]*)$", 1))


def with_file_type(files: DataFrame) -> DataFrame:
    """SRC-4: ext, file_name, parent_path; backslashes become slashes."""
    path = unix_path(F.col("path"))
    return files.withColumns({
        "path": path,
        "ext": extension(path),
        "file_name": file_name(path),
        "parent_path": F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(""),
    })


def with_file_metrics(files: DataFrame) -> DataFrame:
    """SRC-5: characters, and lines without counting empty ones at the end."""
    body = F.regexp_replace("content", r"\n+$", "")
    lines = F.when((body == "") & (F.length("content") > 0), 0).otherwise(F.size(F.split(body, "\n")))
    return files.withColumns({"line_count": lines, "char_count": F.length("content")})


def file_counts(files: DataFrame) -> DataFrame:
    """SRC-6: one row with the number of files by type."""
    ends = lambda e: F.count_if(F.col("path").endswith(e))
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        ends(".java").alias("java_files"), ends(".xml").alias("xml_files"), ends(".sql").alias("sql_files"),
    )


def drop_large(files: DataFrame, mb: float = fv.MAX_FILE_MB) -> DataFrame:
    """SRC-8."""
    return files.where(F.octet_length("content") <= int(mb * 1024 * 1024))
