"""Which columns each report needs, checked on the plan before any job runs.

A delivered table may lack columns; its layout still has them, empty throughout, and a report over an empty
column would show NULL for every indicator. Readers therefore mark such columns as absent, the mark stays with the column
through filters, joins and projections, and every report refuses to run on a column that it needs and that is
marked or missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

ABSENT = "absent_in_delivery"

_COMPLIANCE = ("inclusion", "met_sla", "closed_in_period")
_SPEED = ("elapsed_minutes", "sla_minutes")
_EFFECTIVENESS = (
    "closed_in_period", "solved_pending_close", "closed_early_next", "due_in_month", "solved_early_next",
    "overdue_prev_months", "closed_early_prev",
)
_BACKLOG = ("solved_at", "due_in_month", "overdue_prev_months")
_ESTIMATES = ("missed", "inclusion", "met_sla", "closed_in_period")
_ESTIMATED_EFFECTIVENESS = (
    "closed_met_sla", "solved_pending_close_met_sla", "still_pending_met_sla", "solved_pending_close",
    "still_pending", "overdue_prev_months", "due_in_month", "solved_early_next",
)

#: Report -> the case columns it cannot do without, beside those named in its parameters.
NEEDS: dict[str, tuple[str, ...]] = {
    "kpi_compliance": _COMPLIANCE,
    "kpi_speed": _SPEED,
    "kpi_effectiveness": _EFFECTIVENESS,
    "kpi_missed": ("missed",),
    # Six indicators in one table: without the columns of all of them the others are still shown, and those
    # whose columns were not delivered are NULL.
    "scorecard": ("area", "missed", "solved_at", *_COMPLIANCE),
    "indicator_detail": _ESTIMATES,
    "indicator_detail_effectiveness": (*_ESTIMATES, *_ESTIMATED_EFFECTIVENESS),
    "active_backlog": ("area", "grp", "subgrp", "specialist", "solved_at", "due_in_month", "met_sla"),
    "capacity_outlook": ("area", *_BACKLOG),
    "pivot_summary": (),
    "frequent_ci": ("area", "grp", "ci", "service", "case_type", "registered_at"),
    "state_matrix": ("state", "specialist"),
    "worklist": (
        "case_id", "case_type", "state", "area", "grp", "subgrp", "specialist", "service", "registered_at",
        "due_at", "elapsed_minutes", "sla_minutes", "met_sla", "progress_text", "site", "ci",
    ),
    "scatter_points": (
        "case_id", "area", "case_type", "state", "grp", "service", "progress_text", "elapsed_minutes",
    ),
    "select_region": (
        "case_id", "area", "grp", "specialist", "service", "state", "progress_text", "elapsed_minutes",
    ),
    "recurrent_cases": ("area", "specialist", "case_id"),
    "hourly_arrivals": ("case_id", "registered_at", "case_type"),
    "backlog_trend": ("registered_at", "solved_at", "due_at"),
    "running_compliance": ("area", "solved_at", "inclusion", "missed", "met_sla", "closed_in_period"),
    "top_specialists": ("specialist", "area", "missed"),
    "top_sites": ("site", "category", "service_type", "case_type"),
    "category_flow": ("area", "grp", "category_path", "case_type"),
    "open_flow": ("area", "specialist", "state"),
    "ci_state_flow": ("ci", "state"),
    "client_pending_flow": ("area", "service", "category", "specialist"),
}


class MissingColumns(ValueError):
    """A report was asked of a table that was delivered without columns it needs."""


def mark_absent(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The same rows; the columns are marked as not delivered."""
    for name in columns:
        df = df.withMetadata(name, {**df.schema[name].metadata, ABSENT: True})
    return df


def absent(df: DataFrame) -> list[str]:
    """Columns that the table has only in name."""
    return [f.name for f in df.schema.fields if f.metadata.get(ABSENT)]


def missing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of the columns that the table lacks or has only in name."""
    there = set(df.columns) - set(absent(df))
    return [c for c in dict.fromkeys(columns) if c not in there]


def require(df: DataFrame, report: str, *more: str) -> None:
    """Raise ``MissingColumns`` unless the table has what the report needs. Runs no job."""
    lacking = missing(df, (*NEEDS[report], *more))
    if lacking:
        raise MissingColumns(f"{report} needs the columns {lacking}, which were not delivered")


def reports_without_columns(df: DataFrame) -> dict[str, list[str]]:
    """Reports that cannot be made of a table, each with the columns it lacks."""
    found = {report: missing(df, needed) for report, needed in NEEDS.items()}
    return {report: lacking for report, lacking in found.items() if lacking}
