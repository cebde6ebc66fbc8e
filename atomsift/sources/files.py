"""Discovery and small-file access on local and Hadoop-style file systems."""

from __future__ import annotations

import fnmatch
import io
import os
import posixpath
from collections.abc import Sequence

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default name patterns of structure files.
DEFAULT_PATTERNS = ["vasprun*.xml", "XDATCAR*", "*.xyz", "*.extxyz", "*.traj"]


def plain_path(column):
    """file:/a and file:///a become /a; other schemes stay."""
    return F.regexp_replace(column, "^file:/+", "/")


def open_binary(path: str):
    """Seekable binary stream of a local path or URI."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner))


def absolute(path) -> str:
    """A local path without ``~`` and relative parts; a URI as it is."""
    path = str(path)
    return path if "://" in path else os.path.realpath(os.path.expanduser(path))


def make_folder(path) -> str:
    """The absolute path of a folder, made if it is missing; local or remote."""
    path = absolute(path)
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    return path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_text(path: str, text: str) -> str:
    path = absolute(path)
    system, inner = file_system(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(text.encode())
    return path


def read_text(path: str) -> str:
    with open_binary(absolute(path)) as f:
        return f.read().decode()


def matching(directory: str, patterns: Sequence[str]) -> list[fs.FileInfo]:
    """Entries of a directory that match a pattern, sorted by name; none if it is absent."""
    system, inner = file_system(directory)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(
        (i for i in found if any(fnmatch.fnmatch(i.base_name, p) for p in patterns)), key=lambda i: i.path
    )


def newest(directory: str, *patterns: str) -> str:
    found = matching(directory, patterns)
    if not found:
        raise FileNotFoundError(f"nothing in {directory} matches {patterns}")
    return max(found, key=lambda i: i.mtime_ns or 0).path


def only_one(directory: str, *patterns: str) -> str:
    found = matching(directory, patterns)
    if not found:
        raise FileNotFoundError(f"nothing in {directory} matches {patterns}")
    if len(found) > 1:
        raise RuntimeError(f"several entries match {patterns}: {[i.path for i in found]}")
    return found[0].path


def clear_outputs(directory: str, patterns: Sequence[str]) -> list[str]:
    """Remove matching files and table folders; returns what was removed."""
    system, _ = file_system(directory)
    removed = []
    for info in matching(directory, patterns):
        if info.type == fs.FileType.Directory:
            system.delete_dir(info.path)
        else:
            system.delete_file(info.path)
        removed.append(info.path)
    return removed


def discover_structure_files(
    spark: SparkSession,
    roots: Sequence[str],
    patterns: Sequence[str] | str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """file_path, length of the structure files under the roots, each once.

    Spark lists the folders; contents are not read. An explicit file counts
    only if its name matches a pattern. ``~`` and relative roots are made
    absolute. Spark's lister takes names that begin with ``_`` or ``.`` for
    hidden ones, and so does this function: such files and folders are skipped.
    """
    if isinstance(patterns, str):
        patterns = [patterns]
    found = None
    for root in map(absolute, roots):
        for pattern in patterns or DEFAULT_PATTERNS:
            reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            if recursive:
                reader = reader.option("recursiveFileLookup", "true")
            try:
                part = reader.load(root).select(plain_path("path").alias("file_path"), "length")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" in str(e):
                    raise FileNotFoundError(f"cannot read {root}: no such file or folder") from e
                raise
            found = part if found is None else found.unionByName(part)
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"no file below {list(roots)} has a name like {patterns or DEFAULT_PATTERNS}")
    return found.dropDuplicates(["file_path"])


def discover_vasprun_files(
    spark: SparkSession, roots: Sequence[str], pattern: str = "vasprun*.xml", recursive: bool = True
) -> DataFrame:
    return discover_structure_files(spark, roots, [pattern], recursive)
