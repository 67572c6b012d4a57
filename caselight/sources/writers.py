"""Sinks: snapshot refresh and result export. All writers are distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight import schema
from caselight.functions import contract
from caselight.sources import files, intake, store
from caselight.sources.readers import CSV_OPTIONS, read_cases


class TooManyRejects(ValueError):
    """A delivery has more rows that cannot be read than were allowed."""


def refresh_snapshot(
    spark: SparkSession,
    src: str,
    dst: str,
    partition_by: Sequence[str] = (),
    reject_limit: int | None = None,
    **options: str,
) -> store.Version:
    """Replace the stored snapshot by a delivered extract.

    The rows become a new version in the store's folder, which is committed only once all of it
    is written: a refresh that fails leaves the version before as the current one (see ``store``).

    With a ``reject_limit``, files may differ in their headers, and rows that cannot be read go to
    the version's table of rejects (see ``intake``); more of them than the limit are an error,
    and nothing is committed then, but the table is there to look at. The delivery is parsed once.
    Without a limit the extract is read as ``read_cases`` reads it.

    Rows are clustered by area inside each file, so that an area filter skips row
    groups; no shuffle is needed for it. ``partition_by`` puts values into folders; rows are
    then brought together by value first, and large values split again, so that not every
    task writes into every folder.
    """
    version = store.new_version(dst)
    noted = Observation(f"refresh {version.version}")
    # Rows and rejects are written in one job, so a delivery is parsed once; the rejects' folder goes to its place then.
    folders = (*partition_by,)
    if reject_limit is None:
        delivered, rows = None, read_cases(spark, src, **options)
        missing = contract.absent(rows)
    else:
        delivered = intake.take_in_cases(spark, src, **options)
        rows, missing = delivered.observed(lambda df, *counts: df.observe(noted, *counts)), delivered.absent
        folders = (intake.REJECTED, *partition_by)
    if partition_by:
        rows = rows.hint("rebalance", *folders)
    writer = rows.sortWithinPartitions(*folders, "area", "registered_at").write.option("compression", "zstd")
    (writer.partitionBy(*folders) if folders else writer).parquet(version.folder)
    rejected = 0
    # The noted number can be too large where tasks ran twice, but it is 0 only without rejects.
    if delivered is not None and noted.get["rejected"]:
        files.move(spark, f"{version.folder}/{intake.REJECTED}=true", version.rejects_folder)
        rejected = spark.read.schema(intake.REJECTS_LAYOUT).parquet(version.rejects_folder).count()
        if rejected > reject_limit:
            raise TooManyRejects(
                f"{rejected} rows of {src} cannot be read, {reject_limit} are allowed; see {version.rejects_folder}"
            )
    written = spark.read.schema(schema.CASES).parquet(version.folder).count()
    store.commit(spark, dst, version.version, written, rejected, missing, src)
    return store.find(spark, dst, version.version)


def read_rejects(spark: SparkSession, dst: str, version: str | None = None) -> DataFrame:
    """file, row_text and reason of the rows that a version of the store left out."""
    stored = store.find(spark, dst, version)
    if stored is None or not stored.n_rejected:
        return spark.createDataFrame([], intake.REJECTS_LAYOUT)
    return spark.read.schema(intake.REJECTS_LAYOUT).parquet(stored.rejects_folder)


def write_semicolon_csv(df: DataFrame, path: str) -> None:
    """``;``-separated latin1 text with decimal commas; missing values are blank."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    out = [
        F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"\.", ",").alias(f.name)
        if isinstance(f.dataType, fractional)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*out).write.mode("overwrite").options(**CSV_OPTIONS, nullValue="").csv(path)


def export_table(df: DataFrame, path: str) -> None:
    """Result table as comma-separated text with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
