"""Backlog against capacity: the outlook for the month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv
from caselight.functions.columns import ratio
from caselight.functions.contract import require
from caselight.operators.prepare import open_cases, open_condition

OUTLOOK_COLUMNS = (
    "area", "total", "due", "p0", "probability", "spare", "cap_total", "solved", "quota_pct",
)
_ADDED = ("total", "due", "p0", "spare", "cap_total", "solved")
_AVERAGED = ("probability", "quota_pct")
# What every area shows when no case is open.
WHEN_IDLE = {
    "total": 0, "due": 0, "p0": 1.0, "probability": 100.0, "spare": 0.0, "cap_total": 0.0,
    "solved": 0, "quota_pct": 100.0,
}


def active_backlog(cases: DataFrame) -> DataFrame:
    """Open cases per specialist: count, due this month, already missed."""
    require(cases, "active_backlog")
    return (
        open_cases(cases)
        .groupBy("area", "grp", "subgrp", "specialist")
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.sum("due_in_month").alias("due"),
            F.sum(1 - F.col("met_sla")).alias("missed"),
        )
    )


def backlog_sums() -> dict[str, Column]:
    """Open rows, open rows that fall due, solved rows - all from one pass."""
    is_open = open_condition("unsolved")
    return {
        "total": F.when(is_open, 1).otherwise(0),
        "due": F.when(is_open, F.col("due_in_month") + F.col("overdue_prev_months")),
        "solved": F.when(is_open, 0).otherwise(1),
    }


def backlog_by_area(cases: DataFrame) -> DataFrame:
    return cases.groupBy("area").agg(*[F.sum(c).alias(n) for n, c in backlog_sums().items()])


def join_capacity(backlog: DataFrame, capacity: DataFrame, as_of: date) -> DataFrame:
    """Backlog per area with the capacity left on the day; areas in one table only drop out.

    Of repeated rows of an area and day the largest counts, as in the outlook.
    """
    today = capacity.filter(F.col("day") == as_of.day).groupBy("area").agg(F.max("p0").alias("p0"))
    return backlog.join(today, "area", "inner")


def _over_all_areas(sum_of: str) -> Column:
    # The table has one row per area: this window sees as many rows as there are areas.
    return F.coalesce(F.sum(sum_of).over(Window.partitionBy()), F.lit(0))


def _month_capacity(capacity: DataFrame, as_of: date) -> DataFrame:
    """Capacity of the day and of day 1 in one row per area.

    The table has one row per area and day; of repeated ones the largest counts.
    """

    def on(day: int) -> Column:
        return F.max(F.when(F.col("day") == day, F.col("p0")))

    return (
        capacity.groupBy("area")
        .agg(on(as_of.day).alias("p0"), on(1).alias("cap_total"))
        .withColumn("_listed", F.lit(True))
    )


def attach_capacity(
    per_area: DataFrame, capacity: DataFrame, as_of: date, how: str = "left"
) -> DataFrame:
    """Capacity of the day and of day 1, chance to finish, spare capacity and quota.

    ``_counted`` marks the areas that have open cases, solved cases and both capacities;
    only those enter the outlook. ``_idle`` tells that no area has an open case: then
    every area shows the same constants. ``how="full"`` keeps areas without cases.
    """
    joined = per_area.join(_month_capacity(capacity, as_of), "area", how)
    p0, due = F.col("p0"), F.col("due")
    uncapped = 100 * ratio(p0, due)
    chance = F.when(((due == 0) & (p0 > 0)) | (uncapped > 100), F.lit(100.0)).otherwise(uncapped)
    counted = (
        (F.col("total") > 0)
        & (F.col("solved") > 0)
        & p0.isNotNull()
        & F.col("cap_total").isNotNull()
    )
    return joined.select(
        "*",
        chance.alias("probability"),
        (p0 - due).alias("spare"),
        (ratio(F.col("solved"), F.col("cap_total")) * 100).alias("quota_pct"),
        F.coalesce(counted, F.lit(False)).alias("_counted"),
        (_over_all_areas("total") == 0).alias("_idle"),
    )


def with_total_row(measured: DataFrame, plain_sums: list[str], label: str) -> DataFrame:
    """Area rows and one total row: sums of counts, means of percentages.

    The input has one row per area, so grouping sets cost nothing here. Capacity columns
    come from counted areas only, ``plain_sums`` from all.
    """
    counted, idle = F.col("_counted"), F.col("_idle")
    keyed = measured.select(
        "*", F.col("p0").alias("_p0_key"), F.col("cap_total").alias("_cap_key")
    )
    keys = ["area", "_p0_key", "_cap_key"]
    rows = keyed.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        *[F.sum(c).alias(c) for c in plain_sums],
        *[F.sum(F.when(counted, F.col(c))).alias(c) for c in _ADDED],
        *[F.avg(F.when(counted, F.col(c))).alias(c) for c in _AVERAGED],
        F.max("_idle").alias("_idle"),
        F.max("_counted").alias("_counted"),
        (F.grouping("area") == 1).alias("_is_total"),
    )
    return rows.select(
        F.when(F.col("_is_total"), F.lit(label)).otherwise(F.col("area")).alias("area"),
        *plain_sums,
        *[F.when(idle, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in WHEN_IDLE.items()],
        "_idle",
        "_counted",
    )


def capacity_outlook(
    cases: DataFrame, capacity: DataFrame, as_of: date, total_label: str = fv.TOTAL
) -> DataFrame:
    """Month outlook per area and in total.

    If no case is open at all, every area of the capacity table and the total get the
    same constant row.
    """
    require(cases, "capacity_outlook")
    measured = attach_capacity(backlog_by_area(cases), capacity, as_of, how="full")
    shown = measured.filter(~F.col("_idle") | F.col("_listed"))
    rows = with_total_row(shown, [], total_label)
    return rows.filter(F.col("_counted") | F.col("_idle")).select(*OUTLOOK_COLUMNS)
