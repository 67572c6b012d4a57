"""Files of any file system that Spark reads: listing, first lines, removal.

The driver asks the file system that Spark itself uses, so paths may be local or remote. Only names and first
lines pass through it, never rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _opened(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it."""
    system, place = _opened(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a folder another place on the same file system; the folder that it goes to is made."""
    system, place = _opened(spark, path)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"{path} cannot be moved to {target}")


def folders(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the folders in a folder, with the time of their last change in milliseconds."""
    system, place = _opened(spark, path)
    if not system.exists(place):
        return {}
    return {
        s.getPath().getName(): s.getModificationTime() for s in system.listStatus(place) if s.isDirectory()
    }


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path or pattern that hold data, sorted; hidden and empty ones are left out."""
    system, place = _opened(spark, path)
    found, waiting = [], list(system.globStatus(place) or [])
    if not waiting:
        raise FileNotFoundError(path)
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += [s for s in system.listStatus(status.getPath()) if s.getPath().getName()[0] not in "._"]
        elif status.getLen() > 0:
            found.append(status.getPath().toString())
    return sorted(found)


def first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The first line of a file, unpacked where its name tells that it is packed."""
    system, place = _opened(spark, path)
    jvm = spark._jvm
    stream = system.open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
            spark._jsc.hadoopConfiguration()
        ).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, encoding)).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("﻿")


def files_by_first_line(spark: SparkSession, path: str, encoding: str, at_once: int = 16) -> dict[str, list[str]]:
    """The data files of a folder, those with the same first line together."""
    paths = data_files(spark, path)
    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(lambda p: first_line(spark, p, encoding), paths))
    groups: dict[str, list[str]] = {}
    for line, file in zip(lines, paths):
        groups.setdefault(line, []).append(file)
    return groups
