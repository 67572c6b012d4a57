"""Listings, selections, recurrence and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.functions.columns import decimal_comma
from caselight.functions.contract import require
from caselight.operators.prepare import by_area, open_cases, scope


def case_listing(cases: DataFrame) -> DataFrame:
    return cases.select(*schema.CASE_COLUMNS)


def worklist(cases: DataFrame, area: str | None = None) -> DataFrame:
    """Actionable cases with numeric progress."""
    require(cases, "worklist")
    return (
        by_area(open_cases(cases, "actionable"), area)
        .withColumn("progress", decimal_comma(F.col("progress_text")))
        .select(*schema.WORKLIST_COLUMNS)
    )


def _with_progress(cases: DataFrame) -> DataFrame:
    return open_cases(cases, "state").withColumn(
        "progress", decimal_comma(F.col("progress_text"))
    )


def _label() -> Column:
    return F.concat(F.col("grp"), F.lit("  -  "), F.col("service"))


def scatter_points(cases: DataFrame, log_axes: bool = False) -> DataFrame:
    """Progress against elapsed time of open cases; log axes show positive values only."""
    require(cases, "scatter_points")
    points = _with_progress(cases)
    if log_axes:
        points = points.filter((F.col("progress") > 0) & (F.col("elapsed_minutes") > 0))
    return points.withColumn("label", _label()).select(*schema.SCATTER_COLUMNS)


def select_region(
    cases: DataFrame,
    area: str,
    x_range: tuple[float, float],
    y_range: tuple[float, float],
    labelled: bool = False,
) -> DataFrame:
    """Open cases inside a rectangle of progress and elapsed minutes, bounds included.

    ``labelled`` adds the label that the points carry.
    """
    require(cases, "select_region")
    chosen = by_area(_with_progress(cases), area).filter(
        F.col("progress").between(*x_range) & F.col("elapsed_minutes").between(*y_range)
    )
    columns = [F.col(c) for c in schema.SELECTION_COLUMNS]
    return chosen.select(*columns, *([_label().alias("label")] if labelled else []))


def recurrent_cases(pending: DataFrame, area: str | None = None) -> DataFrame:
    """Cases that wait for the client more than once with the same specialist."""
    require(pending, "recurrent_cases")
    return (
        by_area(pending, area)
        .groupBy("area", "specialist", "case_id")
        .agg(F.count(F.lit(1)).alias("total"))
        .filter(F.col("total") > 1)
    )


def distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def first_per_case(
    df: DataFrame, order: Sequence[str], key: Sequence[str] = ("case_id",)
) -> DataFrame:
    """First row of each case.

    The row-number limit is applied before the shuffle as well, so a case id that fills
    many rows sends one row per map task. What is shuffled is the given columns, so choose the
    first rows among narrow ones and add texts to those that are left. ``key`` names the columns that
    tell cases apart: where rows lie together by one of them already, as after a join on
    it, nothing is shuffled at all.
    """
    earliest = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(earliest)).filter(F.col("_rn") == 1).drop("_rn")
    )


def top_specialists(
    cases: DataFrame, n: int = fv.TOP_N, labels: fv.Labels = fv.ENGLISH
) -> DataFrame:
    """Specialists with most missed cases, one message per area they work in.

    Areas are carried along in the aggregate, so the list is not joined back to the cases.
    """
    require(cases, "top_specialists")
    per_area = cases.groupBy("specialist", "area").agg(F.sum("missed").alias("missed"))
    return (
        per_area.groupBy("specialist")
        .agg(F.sum("missed").alias("missed"), F.collect_list(F.struct("area")).alias("_areas"))
        .orderBy(F.desc("missed"), "specialist")
        .limit(n)
        .select("specialist", "missed", F.inline("_areas"))
        .withColumn(
            "message",
            F.concat(F.col("missed").cast("string"), F.lit(labels.missed_message), F.col("area")),
        )
    )


def top_sites(cases: DataFrame, n: int = fv.TOP_N, labels: fv.Labels = fv.ENGLISH) -> DataFrame:
    """Sites and categories with most end-user incidents."""
    require(cases, "top_sites")
    return (
        scope(cases, service_type="END_USER", case_type="INCIDENT")
        .groupBy("site", "category")
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "site", "category")
        .limit(n)
        .withColumn(
            "message",
            F.concat(
                F.col("total").cast("string"), F.lit(labels.incidents_message), F.col("category")
            ),
        )
    )
