"""Indicators per unit and in total, bands and the scorecard.

Every indicator is a function of sums. The fact rows are therefore summed once per unit
and the total is the sum of those few rows: no row is duplicated for the total, as
grouping sets over the fact table would do.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.functions.columns import half_even, ratio
from caselight.functions.contract import require
from caselight.operators import bands, capacity as cap
from caselight.operators.prepare import included

INCLUDED = "INCLUDED"


def add_total(sums: DataFrame, by: list[str], label: str = fv.TOTAL) -> DataFrame:
    """Append one row with the sums over all units to a table of sums per unit."""
    if not by:
        return sums
    measures = [c for c in sums.columns if c not in by]
    is_total = F.grouping(by[0]) == 1
    both = sums.groupingSets([[F.col(c) for c in by], []], *by).agg(
        *[F.sum(m).alias(m) for m in measures], is_total.alias("_total")
    )
    keys = [
        F.when(F.col("_total"), F.lit(label)).otherwise(F.col(c)).alias(c) for c in by
    ]
    return both.select(*keys, *measures)


def _sums(df: DataFrame, by: list[str], total: bool, measures: dict[str, Column]) -> DataFrame:
    out = df.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in measures.items()])
    return add_total(out, by) if total else out


def _compliance_sums(included_only: bool = False) -> dict[str, Column]:
    met, closed = F.col("met_sla"), F.col("closed_in_period")
    if not included_only:
        counts = F.col("inclusion") == INCLUDED
        met, closed = F.when(counts, met), F.when(counts, closed)
    return {"met": met, "closed": closed}


def _speed_sums() -> dict[str, Column]:
    return {"elapsed": F.col("elapsed_minutes"), "allowed": F.col("sla_minutes")}


EFFECTIVENESS_DONE = ("closed_in_period", "solved_pending_close")
EFFECTIVENESS_BASE = (
    "closed_early_next", "due_in_month", "solved_early_next", "overdue_prev_months",
    "closed_early_prev",
)


def _effectiveness_sums() -> dict[str, Column]:
    return {c: F.col(c) for c in EFFECTIVENESS_DONE + EFFECTIVENESS_BASE}


def _missed_sums() -> dict[str, Column]:
    return {"missed": F.when(F.col("missed") == 1, 1).otherwise(0), "cases": F.lit(1)}


def _ics() -> Column:
    return F.expr("try_divide(met, closed)")


def _ivs() -> Column:
    return F.expr("try_divide(elapsed, allowed)")


def _ies() -> Column:
    return F.expr(
        """try_divide(
             closed_in_period + solved_pending_close,
             closed_early_next + due_in_month + solved_early_next + overdue_prev_months
               - closed_early_prev)"""
    )


def _missed_percent() -> Column:
    return half_even(ratio(F.col("missed"), F.col("cases")) * 100, 2)


def _missed_limit() -> Column:
    return half_even(F.col("cases") * fv.MISSED_SHARE).cast("bigint")


def kpi_compliance(cases: DataFrame, by: Sequence[str] = (), total: bool = True) -> DataFrame:
    """ICS: met over closed, included rows only."""
    require(cases, "kpi_compliance", *by)
    sums = _sums(included(cases), list(by), total, _compliance_sums(included_only=True))
    return sums.select(*by, _ics().alias("ics"))


def kpi_speed(cases: DataFrame, by: Sequence[str] = (), total: bool = True) -> DataFrame:
    """IVS: minutes used over minutes allowed, all rows."""
    require(cases, "kpi_speed", *by)
    return _sums(cases, list(by), total, _speed_sums()).select(*by, _ivs().alias("ivs"))


def kpi_effectiveness(cases: DataFrame, by: Sequence[str] = (), total: bool = True) -> DataFrame:
    """IES: closed or solved over what had to be closed in the month."""
    require(cases, "kpi_effectiveness", *by)
    return _sums(cases, list(by), total, _effectiveness_sums()).select(*by, _ies().alias("ies"))


def kpi_missed(cases: DataFrame, by: Sequence[str] = (), total: bool = True) -> DataFrame:
    """Missed cases, their share in percent and the limit (5 % of all cases)."""
    require(cases, "kpi_missed", *by)
    return (
        _sums(cases, list(by), total, _missed_sums())
        .select(
            *by,
            "missed",
            _missed_percent().alias("missed_pct"),
            _missed_limit().alias("missed_limit"),
        )
        .withColumn("missed_band", bands.missed_band("missed", "missed_limit"))
    )


def kpi_solved(outlook: DataFrame) -> DataFrame:
    """Solved so far against the month's quota, from the capacity outlook."""
    return outlook.select(
        "area", "solved", "quota_pct", bands.quota_band("quota_pct").alias("solved_band")
    )


def kpi_to_close(outlook: DataFrame) -> DataFrame:
    """Cases to close this month against capacity, from the capacity outlook."""
    return outlook.select(
        "area", "due", "p0", bands.capacity_band("due", "p0").alias("to_close_band")
    )


def _targets_wide(spark: SparkSession, targets, total_label: str) -> DataFrame:
    """One row per area from (area, kpi, target, tolerance) rows or a DataFrame of any size.

    No hint: Spark knows the size of parameter rows and broadcasts them if they are few.
    """
    if not isinstance(targets, DataFrame):
        rows = [(area, kpi, float(goal), float(near)) for area, kpi, goal, near in targets]
        layout = "area string, kpi string, target double, tolerance double"
        targets = spark.createDataFrame(rows, layout)
    area = F.when(F.col("area") == fv.TOTAL, F.lit(total_label)).otherwise(F.col("area"))
    wide = [
        F.max(F.when(F.col("kpi") == kpi, F.col(c).cast("double"))).alias(f"{kpi}_{short}")
        for kpi in ("ics", "ies")
        for c, short in (("target", "target"), ("tolerance", "tol"))
    ]
    return targets.groupBy(area.alias("area")).agg(*wide)


def _scored(
    cases: DataFrame, capacity: DataFrame, as_of: date, targets, total_label: str
) -> DataFrame:
    require(cases, "scorecard")
    plain = {
        **_compliance_sums(),
        **_speed_sums(),
        **_effectiveness_sums(),
        **_missed_sums(),
    }
    sums = {**plain, **cap.backlog_sums()}
    per_area = cases.groupBy("area").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    measured = cap.attach_capacity(per_area, capacity, as_of)
    row = cap.with_total_row(measured, list(plain), total_label).select(
        "area",
        _ics().alias("ics"),
        _ivs().alias("ivs"),
        _ies().alias("ies"),
        "due",
        "p0",
        "solved",
        "quota_pct",
        "missed",
        _missed_percent().alias("missed_pct"),
        _missed_limit().alias("missed_limit"),
    )
    goals = _targets_wide(cases.sparkSession, targets, total_label)
    return row.join(goals, "area", "left").select(
        *row.columns,
        bands.target_band("ics", "ics_target", "ics_tol").alias("ics_band"),
        bands.speed_band("ivs").alias("ivs_band"),
        bands.target_band("ies", "ies_target", "ies_tol").alias("ies_band"),
        bands.capacity_band("due", "p0").alias("to_close_band"),
        bands.quota_band("quota_pct").alias("solved_band"),
        bands.missed_band("missed", "missed_limit").alias("missed_band"),
        "ics_target",
        "ics_tol",
        "ies_target",
        "ies_tol",
    )


SCORECARD_COLUMNS = (
    "area", "ics", "ics_band", "ivs", "ivs_band", "ies", "ies_band", "due", "p0",
    "to_close_band", "solved", "quota_pct", "solved_band", "missed", "missed_pct",
    "missed_limit", "missed_band",
)


def scorecard(
    cases: DataFrame,
    capacity: DataFrame,
    as_of: date,
    targets=fv.TARGETS,
    total_label: str = fv.TOTAL,
) -> DataFrame:
    """All six indicators with their bands, per area and in total.

    One pass over the cases. The result of it has one row per area; capacity, total and
    targets are joined to those rows.
    """
    return _scored(cases, capacity, as_of, targets, total_label).select(*SCORECARD_COLUMNS)


def kpi_bands(
    cases: DataFrame,
    capacity: DataFrame,
    as_of: date,
    targets=fv.TARGETS,
    total_label: str = fv.TOTAL,
) -> DataFrame:
    """The scorecard as one row per area and indicator: value, target, tolerance, band.

    The target of the solved quota is 100, of the cases to close the capacity, of the
    missed cases their limit.
    """

    def entry(kpi, value, band, target=None, tolerance=None):
        def number(c):
            return (F.lit(None) if c is None else c).cast("double")

        return F.struct(
            F.lit(kpi).alias("kpi"),
            number(F.col(value)).alias("value"),
            number(target).alias("target"),
            number(tolerance).alias("tolerance"),
            F.col(band).alias("band"),
        )

    entries = F.array(
        entry("ics", "ics", "ics_band", F.col("ics_target"), F.col("ics_tol")),
        entry("ivs", "ivs", "ivs_band"),
        entry("ies", "ies", "ies_band", F.col("ies_target"), F.col("ies_tol")),
        entry("to_close", "due", "to_close_band", F.col("p0"), F.col("p0") * fv.CAPACITY_MARGIN),
        entry("solved", "quota_pct", "solved_band", F.lit(fv.QUOTA_FULL), F.lit(fv.QUOTA_MARGIN)),
        entry("missed", "missed", "missed_band", F.col("missed_limit")),
    )
    scored = _scored(cases, capacity, as_of, targets, total_label)
    return scored.select("area", F.inline(entries))
