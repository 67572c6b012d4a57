"""Indicator tables at nine levels of detail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import percent_text, ratio
from caselight.functions.contract import require


@dataclass(frozen=True)
class Level:
    keys: tuple[str, ...]
    effectiveness: bool = False
    missed_only: bool = False


LEVELS = {
    "total": Level((), effectiveness=True),
    "area": Level(("area",), effectiveness=True),
    "group": Level(("area", "grp"), effectiveness=True),
    "subgroup": Level(("area", "grp", "subgrp"), effectiveness=True),
    "group_category": Level(("area", "grp", "category_path"), missed_only=True),
    "area_category": Level(("area", "category_path"), missed_only=True),
    "specialist": Level(("area", "grp", "specialist")),
    "specialist_category": Level(("area", "grp", "specialist", "category_path")),
    "service_category": Level(("area", "service", "category_path"), missed_only=True),
}


def indicator_detail(
    cases: DataFrame,
    level: str,
    area: str | None = None,
    ordered: bool = True,
    shared_scan: bool = False,
) -> DataFrame:
    """Missed cases, shares and estimated indicators per key of the level.

    ``prop_total`` is the share in all missed cases of every area, also where only one
    area is shown. ``ics_est``, ``ies_est`` and ``ies2`` are defined differently from the
    headline indicators.

    The overall count is a one-row subquery over the same grouping, so group rows are
    never gathered in one task, and both sides share one scan and one shuffle. It sums every
    measure, not only the one it needs: otherwise the two sides would differ.

    Where one area is shown, there is a choice. Without ``shared_scan`` the groups read only that area's rows,
    and the total reads one column of all rows: cheaper over a stored snapshot, whose files skip
    other areas and columns. With it the rows are read once: those of every other area are
    grouped by area alone, a few subtotals beside the groups to show, which together hold the
    total. That is cheaper where the rows come out of joins or other costly steps.

    Rows come with most missed cases first; ``ordered=False`` saves the sort where the table is
    only stored.
    """
    spec = LEVELS[level]
    report = "indicator_detail_effectiveness" if spec.effectiveness else "indicator_detail"
    require(cases, report, *spec.keys, *([] if area is None else ["area"]))
    is_in = F.col("inclusion") == "INCLUDED"
    measures = [
        F.sum("missed").alias("missed"),
        F.count(F.lit(1)).alias("cases"),
        F.count_if(is_in & (F.col("met_sla") != 0)).alias("_met"),
        F.count_if(is_in & (F.col("closed_in_period") != 0)).alias("_closed"),
    ]
    if spec.effectiveness:
        measures += [
            F.sum(c).alias(f"_{c}")
            for c in (
                "closed_met_sla", "solved_pending_close_met_sla", "still_pending_met_sla",
                "closed_in_period", "solved_pending_close", "still_pending",
                "overdue_prev_months", "due_in_month", "solved_early_next",
            )
        ]
    keys, shown = [F.col(k) for k in spec.keys], []
    if area is not None and shared_scan:
        chosen = F.coalesce(F.col("area") == area, F.lit(False))
        keys = [F.col(k) if k == "area" else F.when(chosen, F.col(k)).alias(k) for k in spec.keys]
        # An aggregate, not a key: a filter on it stays above the grouping, and the scan is shared.
        # The total level has no area to show.
        shown = [F.max(chosen if "area" in spec.keys else F.lit(False)).alias("_shown")]
    groups = cases.groupBy(*keys).agg(*measures, *shown)
    sums = [F.sum(c).alias(c) for c in groups.columns if c not in (*spec.keys, "_shown")]
    if shown:
        sums.append(F.max("_shown").alias("_shown"))
    overall = groups.agg(F.struct(*sums).alias("sums"))
    if shown:
        groups = groups.filter("_shown")
    elif area is not None:
        overall = cases.agg(F.struct(F.sum("missed").alias("missed")).alias("sums"))
        groups = groups.filter(F.col("area") == area if "area" in spec.keys else F.lit(False))
    if spec.missed_only:
        groups = groups.filter(F.col("missed") > 0)

    missed, rows = F.col("missed"), F.col("cases")
    out = [*spec.keys, "missed", "cases", ratio(missed, rows).alias("prop_cases")]
    if spec.keys:
        out.append(ratio(missed, overall.scalar().getField("missed")).alias("prop_total"))
    out += [
        ratio(rows - missed, rows).alias("ics"),
        ratio(F.col("_met"), F.col("_closed")).alias("ics_est"),
    ]
    if spec.effectiveness:
        base = F.col("_overdue_prev_months") + F.col("_due_in_month") + F.col("_solved_early_next")
        within_sla = (
            F.col("_closed_met_sla")
            + F.col("_solved_pending_close_met_sla")
            + F.col("_still_pending_met_sla")
        )
        handled = (
            F.col("_closed_in_period") + F.col("_solved_pending_close") + F.col("_still_pending")
        )
        out += [ratio(within_sla, base).alias("ies_est"), ratio(handled, base).alias("ies2")]
    table = groups.select(*out)
    return table.orderBy(F.desc("missed"), *spec.keys) if ordered and spec.keys else table


SHARES = ("prop_cases", "prop_total", "ics", "ics_est", "ies_est", "ies2")


def as_shown(table: DataFrame) -> DataFrame:
    """An indicator table as it is listed: shares as percent text, blank where there is none."""
    shown = {c: F.coalesce(percent_text(F.col(c)), F.lit("")) for c in SHARES if c in table.columns}
    return table.withColumns(shown)
