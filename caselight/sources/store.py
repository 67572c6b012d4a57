"""A folder of versions, of which readers see the one that was committed last.

``folder/_store/versions/<version>``  rows as Parquet, one folder per refresh, never changed
``folder/_store/rejects/<version>``   rows of the delivery that were rejected, if there are any
``folder/_store/log``                 one small file per commit, naming a version

A version is written first and committed last, by one more file in the log, which appears in one step on every
file system that Spark writes to. Until then, and for good if the refresh fails, readers find the version before.
A job that has begun to read a version can finish it, as no later refresh touches its files. Versions are
removed only by ``remove_old``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caselight.sources import files

_LOG_LAYOUT = (
    "number bigint, version string, committed_at timestamp, n_rows bigint, n_rejected bigint,"
    " absent array<string>, source string"
)


@dataclass(frozen=True)
class Version:
    version: str
    folder: str
    rejects_folder: str
    n_rows: int
    n_rejected: int
    absent: tuple[str, ...]


def _inner(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), "_store", *parts])


def new_version(path: str) -> Version:
    """A name for a version to be written, and its folders. Nothing is made yet."""
    name = f"{time.strftime('%Y%m%d-%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"
    return Version(name, _inner(path, "versions", name), _inner(path, "rejects", name), 0, 0, ())


def history(spark: SparkSession, path: str) -> DataFrame:
    """All commits, one row each; the last one has the largest number (then version)."""
    return spark.read.schema(_LOG_LAYOUT).json(_inner(path, "log"))


def find(spark: SparkSession, path: str, version: str | None = None) -> Version | None:
    """The current version or the named one; None for a folder that is no store."""
    if not files.exists(spark, _inner(path, "log")):
        return None
    commits = history(spark, path)
    if version is not None:
        commits = commits.filter(commits.version == version)
    last = commits.orderBy("number", "version", ascending=False).first()
    if last is None:
        if version is None:
            return None
        raise ValueError(f"{path} has no version {version}")
    folders = _inner(path, "versions", last.version), _inner(path, "rejects", last.version)
    return Version(last.version, *folders, last.n_rows, last.n_rejected, tuple(last.absent))


def commit(
    spark: SparkSession,
    path: str,
    version: str,
    n_rows: int,
    n_rejected: int = 0,
    absent: Sequence[str] = (),
    source: str = "",
) -> None:
    """Make a version, whose rows are written already, the current one."""
    number = 0
    if files.exists(spark, _inner(path, "log")):
        number = history(spark, path).agg({"number": "max"}).first()[0] or 0
    entry = spark.createDataFrame(
        [(number + 1, version, None, n_rows, n_rejected, list(absent), source)], _LOG_LAYOUT
    ).selectExpr("number", "version", "current_timestamp() AS committed_at", "n_rows", "n_rejected", "absent", "source")
    entry.coalesce(1).write.mode("append").json(_inner(path, "log"))


def roll_back(spark: SparkSession, path: str, version: str) -> None:
    """Make an earlier version the current one again."""
    earlier = find(spark, path, version)
    if earlier is None or not files.exists(spark, earlier.folder):
        raise ValueError(f"{path} has no version {version}")
    commit(spark, path, version, earlier.n_rows, earlier.n_rejected, earlier.absent, f"roll back to {version}")


def remove_old(spark: SparkSession, path: str, keep: int = 3, unfinished_hours: float = 24.0) -> list[str]:
    """Remove the folders of all versions but the last ``keep`` committed ones; returns their names.

    The current version always stays. A folder without a commit may belong to a refresh that still runs;
    it goes once it has not changed for ``unfinished_hours``.
    """
    current = find(spark, path)
    if current is None:
        return []
    commits = history(spark, path).orderBy("number", "version", ascending=False).select("version").collect()
    names = list(dict.fromkeys(c.version for c in commits))
    kept = {current.version, *names[: max(keep, 1)]}
    too_young = (time.time() - unfinished_hours * 3600) * 1000
    gone = []
    for kind in ("versions", "rejects"):
        for name, changed in files.folders(spark, _inner(path, kind)).items():
            if name in kept or (name not in names and changed > too_young):
                continue
            files.remove(spark, _inner(path, kind, name))
            gone.append(name)
    return sorted(set(gone))
