"""Repositories as DataFrames: file listing, document reading, include / exclude filters and the repo registry."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import text as t
from codeweft.session import broadcast_if_small, cut

# The default filters of an ingest request.
INCLUDE_GLOBS = ["**/*.*"]
EXCLUDE_GLOBS = ["**/.git/**", "**/node_modules/**", "**/venv/**", "**/__pycache__/**"]
LANGUAGES = ["python", "typescript", "javascript"]


def glob_filter(files: DataFrame, include: Iterable[str] = INCLUDE_GLOBS, exclude: Iterable[str] = EXCLUDE_GLOBS) -> DataFrame:
    """Keep paths that match any include pattern and no exclude pattern (shell patterns over the relative path)."""
    path = F.col("file_path")
    return files.where(t.matches_any(path, include) & ~t.matches_any(path, exclude))


def language_filter(files: DataFrame, languages: Iterable[str] = LANGUAGES) -> DataFrame:
    """Attach ``language`` by extension and keep the enabled ones."""
    return files.withColumn("language", t.supported_language(F.col("file_path"), languages)).where(F.col("language").isNotNull())


def _filesystem(location: str):
    """Filesystem and bare path of a location: a plain path is local, anything with a scheme goes through its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)


_LISTED = "repo_path string, exclude array<string>, path string, is_folder boolean, size long"


def _never_entered(root: str, folder: str, exclude: Iterable[str]) -> bool:
    """Whether some exclude pattern drops every path below ``folder``: it ends in a star, and the rest matches the folder."""
    from fnmatch import fnmatchcase

    below = folder.rstrip("/")[len(root.rstrip("/")) + 1 :] + "/"
    return any(pattern.endswith("*") and fnmatchcase(below, pattern.rstrip("*")) for pattern in exclude)


def _list_folders(folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import os

    from pyarrow import fs

    for batch in folders:
        for row in batch.to_pylist():
            root, exclude, location = row["repo_path"], row["exclude"], row["path"]
            system, bare = _filesystem(location)
            scheme = location[: len(location) - len(bare)] if "://" in location else ""
            found = system.get_file_info(fs.FileSelector(bare))
            local = isinstance(system, fs.LocalFileSystem)
            # Links to folders are not followed: they may lead in circles.
            found = [f for f in found if f.type == fs.FileType.File or not (local and os.path.islink(f.path))]
            found = [f for f in found if f.type != fs.FileType.Directory or not _never_entered(root, scheme + f.path, exclude)]
            yield pa.record_batch(
                [
                    pa.array([root] * len(found), pa.string()),
                    pa.array([exclude] * len(found), pa.list_(pa.string())),
                    pa.array([scheme + f.path for f in found], pa.string()),
                    pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                    pa.array([f.size if f.size is not None else 0 for f in found], pa.int64()),
                ],
                ["repo_path", "exclude", "path", "is_folder", "size"],
            )


def _read_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in files:
        for row in range(len(batch)):
            one = batch.iloc[[row]]
            system, bare = _filesystem(one["path"].iloc[0])
            with system.open_input_stream(bare) as stream:
                # Bytes that are not UTF-8 are dropped.
                yield one.assign(content=[stream.read().decode("utf-8", errors="ignore")])


def scan_repos(roots: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """(repo_path, path, file_path, size) of every file below the given repo_path rows, one folder level per job.

    Folders of which ``exclude`` (or a row's own ``exclude`` list) drops everything are not entered. Spark's own file sources
    skip empty files and names that start with an underscore, which source trees are full of.
    """
    tasks = roots.sparkSession.sparkContext.defaultParallelism
    default = F.array(*[F.lit(p) for p in exclude]).cast("array<string>")
    own = F.coalesce("exclude", default) if "exclude" in roots.columns else default
    folders = roots.select("repo_path", own.alias("exclude"), F.regexp_replace("repo_path", r"(?<=[^/])/+\z", "").alias("path")).distinct()
    files = None
    while True:
        listed = cut(folders.mapInArrow(_list_folders, _LISTED))
        level = listed.where(~F.col("is_folder"))
        files = level if files is None else files.unionByName(level)
        folders = listed.where("is_folder").select("repo_path", "exclude", "path").repartition(tasks, "path")
        if folders.isEmpty():
            break
    start = F.length(F.regexp_replace("repo_path", r"/+\z", "")) + 2
    return files.select("repo_path", "path", F.substring(F.col("path"), start, F.length("path")).alias("file_path"), "size").distinct()


def read_contents(files: DataFrame, bytes_per_task: int = 64 * 1024 * 1024) -> DataFrame:
    """Adds the text of every listed file as ``content``; tasks are sized by the listed bytes, not by the path rows."""
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // bytes_per_task))
    columns = ", ".join(f"{name} {kind}" for name, kind in files.dtypes)
    return files.repartition(tasks, "path").mapInPandas(_read_files, f"{columns}, content string")


FILTERS = ("include", "exclude", "languages")


def read_documents(
    roots: DataFrame,
    include: Iterable[str] = INCLUDE_GLOBS,
    exclude: Iterable[str] = EXCLUDE_GLOBS,
    languages: Iterable[str] = LANGUAGES,
) -> DataFrame:
    """(repo_id, file_path, language, content) of the source files below the repo_path rows; only kept files are opened.

    A row may bring its own filters in array columns ``include``, ``exclude`` and ``languages``; null means the default.
    Each distinct set of filters is one expression. A repo asked for with several sets gives the files of all of them.
    """
    own = [c for c in FILTERS if c in roots.columns]
    found = scan_repos(roots, exclude)
    if not own:
        kept = language_filter(glob_filter(found, include, exclude), languages)
    else:
        defaults = {"include": list(include), "exclude": list(exclude), "languages": list(languages)}
        sets = [r.asDict() for r in roots.select(*own).distinct().collect()]
        same = [[F.col(c).eqNullSafe(_words(one[c])) for c in own] for one in sets]
        number = F.lit(None).cast("int")
        for i, tests in enumerate(same):
            number = F.when(_all(tests), i).otherwise(number)
        asked = roots.select("repo_path", number.alias("filters")).distinct()
        found = found.join(broadcast_if_small(asked), "repo_path")
        path, keep = F.col("file_path"), F.lit(None).cast("string")
        for i, own_set in enumerate(sets):
            use = {c: own_set.get(c) if own_set.get(c) is not None else defaults[c] for c in FILTERS}
            language = F.when(t.matches_any(path, use["include"]) & ~t.matches_any(path, use["exclude"]), t.supported_language(path, use["languages"]))
            keep = F.when(F.col("filters") == i, language).otherwise(keep)
        kept = found.withColumn("language", keep).where(F.col("language").isNotNull()).drop("filters").distinct()
    return read_contents(kept).select(repo_id_of(F.col("repo_path")).alias("repo_id"), "file_path", "language", "content")


def _words(values: list[str] | None) -> Column:
    return F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def repo_id_of(repo_path: Column) -> Column:
    return t.repo_id(F.regexp_replace(repo_path, r"(?<=[^/])/+\z", ""))


def register_repos(registry: DataFrame | None, paths: DataFrame) -> DataFrame:
    """Upsert (repo_path, seq) rows into the registry (repo_id, repo_path, seq); the latest row of a repo wins."""
    path = F.regexp_replace("repo_path", r"(?<=[^/])/+\z", "")
    incoming = paths.select(t.repo_id(path).alias("repo_id"), path.alias("repo_path"), "seq")
    rows = incoming if registry is None else registry.unionByName(incoming)
    newest = F.max(F.struct("seq", "repo_path")).alias("last")
    return rows.groupBy("repo_id").agg(newest).select("repo_id", "last.repo_path", "last.seq")


def known_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    return requests.join(registry.select("repo_id"), "repo_id", "left_semi")


def unknown_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    return requests.join(registry.select("repo_id"), "repo_id", "left_anti")
