"""Source trees, archives and raw files as DataFrames of (path, content)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.identity import normalize_path
from callscope.functions.text import LANGUAGES, is_supported
from callscope.parse import parse_source
from callscope.schema import PARSED_FILE

#: Folders that are not searched: those of the repository scan, and of the script scan (fixed values).
IGNORED = (".git", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
#: Tasks per core that files are dealt to for parsing.
PARSE_TASKS = 4
SCRIPT_IGNORED = (".git", "__pycache__", "venv", ".venv", "build", "tests", "docs")


def _relative(path, root: str):
    """Path below ``root``, whatever scheme Spark puts before it."""
    bare = re.sub(r"^[a-z]+:/+(?=/)", "", root.rstrip("/"))
    bare = re.sub(r"^file:/*", "/", bare)
    return F.regexp_replace(path, "^.*?" + re.escape(bare).replace("\\/", "/") + "/", "")


def _listed(spark: SparkSession, root: str, folder_wanted: Callable[[str], bool], file_wanted: Callable[[str], bool]) -> list[str]:
    """Files below ``root`` by the file system's listing alone; folders that are not wanted are never entered."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, todo = fs.makeQualified(top).toString().rstrip("/"), [], [top]
    while todo:
        for status in fs.listStatus(todo.pop()):
            path = status.getPath().toString()
            below = path[len(base) + 1 :]
            if status.isDirectory():
                if folder_wanted(below):
                    todo.append(status.getPath())
            elif file_wanted(below):
                found.append(path)
    return sorted(found)


def _files(spark: SparkSession, root: str, folder_wanted: Callable[[str], bool], file_wanted: Callable[[str], bool]) -> DataFrame:
    """(path, content) of the wanted files; no other file is read."""
    paths = _listed(spark, root, folder_wanted, file_wanted)
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    escaped = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]
    found = spark.read.format("binaryFile").load(escaped)
    return found.select(_relative(F.col("path"), root).alias("path"), "content")


def _supported(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return "." in name[1:] and "." + name.rsplit(".", 1)[-1].lower() in LANGUAGES


def source_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Files of supported languages below ``root``: (path, content), none in an ignored folder, which is not even listed.

    ``orderBy("path")`` gives their fixed order.
    """
    return _files(spark, root, lambda p: p.rsplit("/", 1)[-1] not in ignored, _supported)


def script_files(spark: SparkSession, root: str) -> DataFrame:
    """Python files only, suffix in lower case, without the folders of ``SCRIPT_IGNORED``."""
    return _files(spark, root, lambda p: p.rsplit("/", 1)[-1] not in SCRIPT_IGNORED, lambda p: p.endswith(".py"))


def seed_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The seeding scan: a folder is left out if an ignored name is anywhere in its path, so ``rebuild/`` is, too."""
    return _files(spark, root, lambda p: not any(i in p for i in ignored), _supported)


def requested_files(changed: DataFrame, repo: str) -> DataFrame:
    """(repo_name, path, sha) to fetch for the files of a change request (filename, status, sha): supported ones that were not removed, by path once."""
    rows = changed.where((F.coalesce("status", F.lit("")) != "removed") & is_supported(F.col("filename")))
    rows = rows.select(F.lit(repo).alias("repo_name"), normalize_path(F.col("filename")).alias("path"), "sha")
    return rows.groupBy("repo_name", "path").agg(F.max("sha").alias("sha"))


def extract_archive(content: bytes) -> list[tuple[str, bytes]]:
    """Files of a zip archive, without its one root folder.

    A member that would leave the folder, more or fewer than one root, and an empty
    archive are ValueErrors.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = [m for m in archive.infolist() if m.filename]
        if not members:
            raise ValueError("the archive is empty")
        for m in members:
            parts = m.filename.replace("\\", "/").split("/")
            if m.filename.startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z]:", m.filename):
                raise ValueError(f"the archive has an unsafe member: {m.filename}")
        roots = {m.filename.replace("\\", "/").split("/")[0] for m in members}
        if len(roots) != 1:
            raise ValueError("the archive must have exactly one root folder")
        cut = len(next(iter(roots))) + 1
        return [(m.filename.replace("\\", "/")[cut:], archive.read(m)) for m in members if not m.is_dir()]


def archive_files(archives: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repo_name, path, content) of the source files in archives (repo_name, content); an archive is one task's."""

    def run(batches):
        for pdf in batches:
            for repo, content in zip(pdf["repo_name"], pdf["content"], strict=True):
                for path, data in extract_archive(bytes(content)):
                    parts = path.split("/")
                    if "." + parts[-1].rsplit(".", 1)[-1].lower() in LANGUAGES and not set(parts[:-1]) & set(ignored):
                        yield pd.DataFrame({"repo_name": [repo], "path": [path], "content": [data]})

    return archives.select("repo_name", "content").mapInPandas(run, "repo_name string, path string, content binary")


def fetched_files(wanted: DataFrame, fetch: Callable[[str, str, str], bytes]) -> DataFrame:
    """(repo_name, path, content) of wanted (repo_name, path, sha); ``fetch(repo, path, sha)`` gets one file, and its error fails the whole."""

    def run(batches):
        for pdf in batches:
            data = [fetch(r, p, s) for r, p, s in zip(pdf["repo_name"], pdf["path"], pdf["sha"], strict=True)]
            yield pd.DataFrame({"repo_name": pdf["repo_name"], "path": pdf["path"], "content": data})

    return wanted.select("repo_name", "path", "sha").mapInPandas(run, "repo_name string, path string, content binary")


def parse_files(files: DataFrame, count_tokens: Callable[[str], int] | None = None) -> DataFrame:
    """repo_name, path, error, and parsed (struct of PARSED_FILE) of each of files (repo_name, path, content).

    A file that can't be parsed has an error and a null record; the others are not affected.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for repo, path, content in zip(pdf["repo_name"], pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((repo, path, None, parse_source(path, content, repo, count_tokens=count_tokens)))
                except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as e:
                    rows.append((repo, path, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["repo_name", "path", "error", "parsed"])

    # Many files may lie in few partitions, as of one small table; parsing is the work, so it is dealt out.
    spread = files.select("repo_name", "path", "content").repartition(PARSE_TASKS * files.sparkSession.sparkContext.defaultParallelism, "repo_name", "path")
    return spread.mapInPandas(run, f"repo_name string, path string, error string, parsed struct<{_as_struct(PARSED_FILE)}>")


def _as_struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def parsed_records(parsed: DataFrame, complete: bool = True, ordered: bool = False) -> DataFrame:
    """repo_name and the columns of PARSED_FILE; with ``complete`` any file that failed is an error, else it is left out; ``ordered``: by path."""
    if complete:
        bad = F.raise_error(F.concat(F.lit("could not parse "), "path", F.lit(": "), "error"))
        parsed = parsed.withColumn("parsed", F.when(F.col("error").isNull(), F.col("parsed")).otherwise(bad.cast(parsed.schema["parsed"].dataType)))
    rows = parsed.where(F.col("parsed").isNotNull()).select("repo_name", "parsed.*")
    return rows.orderBy("repo_name", "file_path") if ordered else rows
