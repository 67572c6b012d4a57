"""Time series: hourly arrivals, business-hour grid, backlog trend, running compliance.

The fact rows are always reduced to one row per hour or day first. The running sums then
work on those rows, whose number is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv
from caselight.functions.columns import (
    hour_number,
    hour_of_number,
    is_weekday,
    month_start,
    ratio,
)
from caselight.functions.contract import require
from caselight.operators.lists import first_per_case
from caselight.operators.prepare import by_area, included, scope, solved_cases


def hourly_arrivals(
    cases: DataFrame,
    area: str | None = None,
    case_type: str | None = None,
    order: Sequence[str] = ("registered_at",),
) -> DataFrame:
    """Cases registered per hour, each case id once; NULL where a type has none.

    With a case type only that column is returned.
    """
    require(cases, "hourly_arrivals", *([] if area is None else ["area"]))
    kept = scope(by_area(cases, area), case_type=case_type)
    # The type settles ties that the given order leaves.
    ordered = [*order, *(c for c in ("registered_at", "case_type") if c not in order)]
    first = first_per_case(kept.select("case_id", *_unique(ordered)), ordered)
    names = {"INCIDENT": "incidents", "REQUEST": "requests"}
    wanted = [case_type] if case_type else list(names)
    counts = first.groupBy(hour_number(F.col("registered_at")).alias("_n")).agg(
        *[F.sum(F.when(F.col("case_type") == t, 1)).alias(names[t]) for t in wanted]
    )
    series = counts.select(
        hour_of_number(F.col("_n")).alias("hour"), *[names[t] for t in wanted]
    )
    if case_type:
        return series
    total = F.coalesce("incidents", F.lit(0)) + F.coalesce("requests", F.lit(0))
    return series.withColumn("total", total)


def _unique(order: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(["registered_at", *order]))


def latest_day(cases: DataFrame, until: date | None = None) -> DataFrame:
    """One row ``as_of``: the last day on which a case was registered."""
    day = F.to_date("registered_at")
    known = cases if until is None else cases.filter(day <= F.lit(until))
    return known.agg(F.max(day).alias("as_of"))


def _hours(spark: SparkSession, as_of: date | DataFrame) -> DataFrame:
    """Every hour from the first of the month to the end of ``as_of``, at most 745 rows."""
    if not isinstance(as_of, DataFrame):
        as_of = spark.range(1).select(F.lit(as_of).alias("as_of"))
    first = month_start(F.col("as_of")).cast("timestamp_ntz")
    last = F.date_add("as_of", 1).cast("timestamp_ntz")
    hour = F.expr("INTERVAL '1' HOUR")
    return as_of.select("as_of", F.explode(F.sequence(first, last, hour)).alias("t"))


def _is_business(t: Column, holidays) -> Column:
    condition = is_weekday(t)
    days = list(holidays)
    return condition & ~F.to_date(t).isin(days) if days else condition


def business_grid(
    spark: SparkSession, as_of: date | DataFrame, holidays=fv.HOLIDAYS
) -> DataFrame:
    """Hours of the month up to ``as_of`` without weekend days and holidays.

    ``as_of`` is a date or a one-row DataFrame such as that of ``latest_day``.
    """
    return _hours(spark, as_of).filter(_is_business(F.col("t"), holidays)).select("t")


def backlog_trend(
    cases: DataFrame, as_of: date | DataFrame, holidays=fv.HOLIDAYS
) -> DataFrame:
    """Cases registered, solved and due before each business hour, and what stays open.

    Only cases due before the last business hour count. An event counts from the first
    full hour after it. So each event is moved to that hour, hours are counted, and the
    counts are summed along the complete grid; weekend hours are left out only
    afterwards, since their events still count on Monday.
    """
    require(cases, "backlog_trend")
    spark = cases.sparkSession
    hours = _hours(spark, as_of)
    business = _is_business(F.col("t"), holidays)
    last = hours.filter(business).agg(F.max("t")).scalar()
    end = hours.agg(F.max("t")).scalar()
    start = hours.agg(F.min(hour_number(F.col("t")))).scalar()

    kinds = {"registered": "registered_at", "solved": "solved_at", "due": "due_at"}
    events = (
        cases.filter(F.col("due_at") < last)
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"))
                        for kind, at in kinds.items()
                    ]
                )
            )
        )
        .filter(F.col("at") < end)
    )
    # The first full hour after the event, or the first of the grid.
    counts_from = F.greatest(hour_number(F.col("at")) + 1, start)
    counted = events.groupBy(counts_from.alias("n")).agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds]
    )
    so_far = (
        Window.partitionBy("as_of").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    )
    running = hours.withColumn("n", hour_number(F.col("t"))).join(counted, "n", "left").select(
        "t",
        *[F.sum(F.coalesce(F.col(k), F.lit(0))).over(so_far).alias(k) for k in kinds],
    )
    a, b, d = F.col("registered"), F.col("solved"), F.col("due")
    lag = F.when((d == 0) & (b == 0), F.lit(0.0)).otherwise((ratio(d, b) - 1) * 100)
    managed = F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(ratio(b, a) * 100)
    return running.filter(business).select(
        "t", *kinds, (a - b).alias("open"), lag.alias("lag_pct"), managed.alias("managed_pct")
    )


def backlog_ratios(trend: DataFrame) -> DataFrame:
    return trend.select("t", "lag_pct", "managed_pct")


#: Days that areas and solve days are matched by; more calendar in fewer steps, or finer steps.
BUCKET_DAYS = 32


def _bucket(day_number: Column) -> Column:
    return F.floor(day_number / F.lit(BUCKET_DAYS)).cast("long")


def running_compliance(
    cases: DataFrame, series: str | None = None, total_label: str = fv.TOTAL
) -> DataFrame:
    """Missed cases and compliance over all solve days so far, per area and in total.

    An area is listed on every solve day of any area from its own first one. One
    aggregation over the cases gives a row per area and day; the first days of the areas,
    the days and the total all come from those rows.
    """
    require(cases, "running_compliance")
    counted = included(solved_cases(cases))
    daily = counted.groupBy("area", F.to_date("solved_at").alias("solved_on")).agg(
        F.sum("missed").alias("missed"),
        F.sum("met_sla").alias("met"),
        F.sum("closed_in_period").alias("closed"),
    )
    sums = ("missed", "met", "closed")

    def rows(area: Column, values: Sequence[Column]) -> Column:
        return F.struct(area.alias("area"), *[v.alias(s) for s, v in zip(sums, values)])

    own = [F.col(s) for s in sums]
    counted_rows = daily.select(
        "solved_on", F.inline(F.array(rows(F.col("area"), own), rows(F.lit(total_label), own)))
    )
    # A zero row of each area for each solve day from its first one on. Days are met by bucket,
    # so that areas and days are joined on equal values and never all in one place.
    bucket = F.unix_date("solved_on").cast("long")
    days = daily.select("solved_on").distinct()
    last = days.agg(F.max(_bucket(bucket))).scalar()
    since = daily.groupBy("area").agg(F.min("solved_on").alias("since"))
    waiting = since.select(
        "area", "since", F.explode(F.sequence(_bucket(F.unix_date("since").cast("long")), last)).alias("bucket")
    )
    zero = (
        days.withColumn("bucket", _bucket(bucket))
        .join(waiting, "bucket")
        .filter(F.col("solved_on") >= F.col("since"))
        .select("solved_on", "area", *[F.lit(0).cast("bigint").alias(s) for s in sums])
    )
    grid = (
        counted_rows.unionByName(zero)
        .groupBy("area", "solved_on")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    if series is not None:
        grid = grid.filter(F.col("area") == series)
    so_far = Window.partitionBy("area").orderBy("solved_on")
    running = grid.select(
        "area", "solved_on", *[F.sum(s).over(so_far).alias(s) for s in sums]
    )
    return running.select(
        "area",
        "solved_on",
        "missed",
        (ratio(F.col("met"), F.col("closed")) * 100).alias("ics_pct"),
    )


def rolling_mean(
    df: DataFrame, ts: str, cols: Sequence[str], n: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Mean over the last n points, NULL points left out; n = 1 changes nothing.

    Meant for aggregated series. Several series in one table are told apart by
    ``partition_by``.
    """
    last_n = Window.partitionBy(*partition_by).orderBy(ts).rowsBetween(-(n - 1), 0)
    return df.withColumns({c: F.avg(c).over(last_n) for c in cols})
