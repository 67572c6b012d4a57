"""Named queries: every operator on the tables of one scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions import columns as k
from caselight.operators import capacity, detail, flows, kpi, lists, pivot, prepare, series
from caselight.plans import deliveries
from caselight.sources import star_tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the test setting, for this data instead of the original one.
AS_OF = date(1998, 6, 15)
HOLIDAYS = (date(1998, 6, 1), date(1998, 6, 8))
BAD_IDS = (213, 473, 562, 1064, 59796)
EXCLUDED_GROUPS = ("NATION_3",)
EXCLUDED_SUBGROUPS = ("MACHINERY",)
AREA = "ASIA"
TARGETS = tuple(
    (area, *goal)
    for area in ("TOTAL", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    for goal in (("ics", 0.61, 0.01), ("ies", 0.395, 0.008))
)
FREQUENT_SHARE = 0.00005
PROGRESS_RANGE = (50.0, 200.0)
ELAPSED_RANGE = (300.0, 1800.0)
ROLL = 3
#: Four standard errors of a sketch.
SKETCH_ERROR = 4 * 0.83 / 2 ** (pivot.SKETCH_BITS / 2)
CASE_ORDER = list(star_tables.CASE_ORDER)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.with_missed(star_tables.cases(spark, sf_dir))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Means of doubles depend on the order of summing; six digits do not."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _listed(df: DataFrame) -> DataFrame:
    return lists.case_listing(df)


def _on_cases(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_cases(spark, sf_dir))


def _on_pending(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(star_tables.client_pending(spark, sf_dir))


def _on_both(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_cases(spark, sf_dir), star_tables.capacity(spark, sf_dir))


def _outlook(cases: DataFrame, cap: DataFrame) -> DataFrame:
    return capacity.capacity_outlook(cases, cap, AS_OF)


def _scorecard(cases: DataFrame, cap: DataFrame) -> DataFrame:
    return _rounded(kpi.scorecard(cases, cap, AS_OF, TARGETS), "quota_pct")


def _bands(cases: DataFrame, cap: DataFrame) -> DataFrame:
    return _rounded(kpi.kpi_bands(cases, cap, AS_OF, TARGETS), "value", "target", "tolerance")


def _detail(level: str) -> Query:
    return _on_cases(lambda c: detail.indicator_detail(c, level))


def _backlog_with_capacity(cases: DataFrame, cap: DataFrame) -> DataFrame:
    backlog = capacity.backlog_by_area(prepare.open_cases(cases)).select("area", "total", "due")
    return capacity.join_capacity(backlog, cap, AS_OF)


def _distinct(cases: DataFrame, agg: str) -> DataFrame:
    """Specialists with cases per area and group, and per case type."""
    offered = pivot.pivot_input(cases)
    types = {"case_type": ["INCIDENT", "REQUEST"]}
    return pivot.pivot_summary(offered, ["area", "grp"], types, value="specialist", agg=agg)


def _sketched(cases: DataFrame) -> DataFrame:
    """Exact counts, and whether the sketch's counts keep within four standard errors of them."""
    exact, rough = (_distinct(cases, agg) for agg in ("count_distinct", "count_distinct_sketch"))
    counts = ("INCIDENT", "REQUEST", "total")
    near = [
        (F.abs(F.col(f"rough_{c}") - F.col(c)) <= F.lit(SKETCH_ERROR) * F.col(c)).alias(f"{c}_near") for c in counts
    ]
    rough = rough.select("area", "grp", "level", *[F.col(c).alias(f"rough_{c}") for c in counts])
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("area", "grp", "level")]
    both = exact.alias("e").join(rough.alias("r"), same[0] & same[1] & same[2])
    return both.select("e.area", "e.grp", "e.level", *counts, *near)


def _arrivals(**options) -> Callable[[DataFrame], DataFrame]:
    return lambda c: series.hourly_arrivals(c, order=CASE_ORDER, **options)


def _trend(cases: DataFrame) -> DataFrame:
    return _rounded(series.backlog_trend(cases, AS_OF, HOLIDAYS), "lag_pct", "managed_pct")


def _first_cases(*key: str) -> Query:
    """The first row of each case, chosen among order lines before any text is joined to them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = star_tables.lines_with_orders(spark, sf_dir)
        first = lists.first_per_case(lines, CASE_ORDER, key)
        return _listed(star_tables.complete(first, sf_dir))

    return run


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A case is registered on the day of its order, so the orders alone give the day.
    orders = star_tables.table(spark, sf_dir, "orders")
    days = orders.select(F.col("o_orderdate").alias("registered_at"))
    return series.business_grid(spark, series.latest_day(days, until=AS_OF), HOLIDAYS)


def _bad_ids(cases: DataFrame) -> DataFrame:
    """The listed cases as a table, as a long list would come."""
    rows = [(i,) for i in BAD_IDS]
    return cases.sparkSession.createDataFrame(rows, "case_id bigint")


def _split(cases: DataFrame) -> DataFrame:
    levels = k.category_levels(F.col("category_path"))
    return cases.select(
        "case_id", "category_path", *[c.alias(f"level_{i}") for i, c in enumerate(levels, 1)]
    )


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case labels carry no accents in this data, document texts do."""
    documents = star_tables.table(spark, sf_dir, "documents")
    return documents.select("doc_id", "lang", k.fold_accents(F.col("text")).alias("folded"))


def _blank_labels(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id",
        k.blank_to(F.col("grp"), "No_Group").alias("grp"),
        k.blank_to(F.col("ci"), "CI not_registered").alias("ci"),
    )


def _progress(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id",
        "progress_text",
        k.decimal_comma(F.col("progress_text")).alias("progress"),
    )


QUERIES: dict[str, Query] = {
    # Sources and base preparation
    "case_listing": _on_cases(_listed),
    "base_missed": _on_cases(lambda c: c.select("case_id", "area", "met_sla", "missed")),
    "exclude_ids": _on_cases(lambda c: _listed(prepare.exclude_cases(c, BAD_IDS))),
    "exclude_ids_join": _on_cases(
        lambda c: _listed(prepare.exclude_cases(c, _bad_ids(c)))
    ),
    "exclude_units": _on_cases(
        lambda c: _listed(prepare.exclude_units(c, EXCLUDED_GROUPS, EXCLUDED_SUBGROUPS))
    ),
    "scope_service": _on_cases(lambda c: _listed(prepare.scope(c, service_type="END_USER"))),
    "scope_type": _on_cases(lambda c: _listed(prepare.scope(c, case_type="INCIDENT"))),
    "pseudonymise": _on_cases(
        lambda c: prepare.pseudonymise(prepare.scope(c, case_type="INCIDENT")).select(
            "case_id", "area", "specialist", "registered_at"
        )
    ),
    "area_listing": _on_cases(lambda c: _listed(prepare.by_area(c, AREA))),
    "open_unsolved": _on_cases(lambda c: _listed(prepare.open_cases(c, "unsolved"))),
    "open_state": _on_cases(lambda c: _listed(prepare.open_cases(c, "state"))),
    "open_actionable": _on_cases(lambda c: _listed(prepare.open_cases(c, "actionable"))),
    "solved_cases": _on_cases(lambda c: _listed(prepare.solved_cases(c))),
    "included_cases": _on_cases(lambda c: _listed(prepare.included(c))),
    "missed_cases": _on_cases(lambda c: _listed(prepare.missed_cases(c))),
    "specialist_worklist": _on_cases(lists.worklist),
    "scatter_selection": _on_cases(
        lambda c: lists.select_region(c, AREA, PROGRESS_RANGE, ELAPSED_RANGE)
    ),
    "selection_labels": _on_cases(
        lambda c: lists.select_region(c, AREA, PROGRESS_RANGE, ELAPSED_RANGE, labelled=True)
    ),
    "worklist_area": _on_cases(lambda c: lists.worklist(c, AREA)),
    "scatter_points": _on_cases(lists.scatter_points),
    "month_window": _on_cases(lambda c: prepare.month_window(_arrivals()(c), "hour", AS_OF)),
    "delivered_cases": deliveries.good_rows,
    "delivery_rejects": deliveries.rejects,
    "refreshed_snapshot": deliveries.refreshed,
    "refused_refresh": deliveries.refused,
    "snapshot_reports": deliveries.reports,
    # Indicators
    "join_capacity": _on_both(_backlog_with_capacity),
    "kpi_ics": _on_cases(lambda c: kpi.kpi_compliance(c, ["area"])),
    "kpi_ivs": _on_cases(lambda c: kpi.kpi_speed(c, ["area"])),
    "kpi_ies": _on_cases(lambda c: kpi.kpi_effectiveness(c, ["area"])),
    "kpi_missed": _on_cases(lambda c: kpi.kpi_missed(c, ["area"])),
    "kpi_solved": _on_both(lambda c, p: _rounded(kpi.kpi_solved(_outlook(c, p)), "quota_pct")),
    "kpi_to_close": _on_both(lambda c, p: kpi.kpi_to_close(_outlook(c, p))),
    "kpi_bands": _on_both(_bands),
    "kpi_scorecard": _on_both(_scorecard),
    "detail_total": _detail("total"),
    "detail_area": _detail("area"),
    "detail_group": _detail("group"),
    "detail_subgroup": _detail("subgroup"),
    "detail_group_category": _detail("group_category"),
    "detail_area_category": _detail("area_category"),
    "detail_specialist": _detail("specialist"),
    "detail_specialist_category": _detail("specialist_category"),
    "detail_service_category": _detail("service_category"),
    "detail_subgroup_area": _on_cases(
        lambda c: detail.indicator_detail(c, "subgroup", area=AREA)
    ),
    "detail_shown": _on_cases(lambda c: detail.as_shown(detail.indicator_detail(c, "group"))),
    "detail_category_area": _on_cases(
        lambda c: detail.indicator_detail(c, "service_category", area=AREA, shared_scan=True)
    ),
    "active_backlog": _on_cases(capacity.active_backlog),
    "capacity_outlook": _on_both(
        lambda c, p: _rounded(_outlook(c, p), "probability", "spare", "quota_pct")
    ),
    "pivot_missed": _on_cases(
        lambda c: pivot.pivot_summary(pivot.pivot_input(c), ["area", "grp", "subgrp"])
    ),
    "pivot_by_type": _on_cases(
        lambda c: pivot.pivot_summary(
            pivot.pivot_input(c), ["area", "grp"], {"case_type": ["INCIDENT", "REQUEST"]}
        )
    ),
    "pivot_missed_area": _on_cases(
        lambda c: pivot.pivot_summary(
            prepare.by_area(pivot.pivot_input(c), AREA), ["area", "grp", "subgrp"]
        )
    ),
    "pivot_avg": _on_cases(
        lambda c: _rounded(
            pivot.pivot_summary(pivot.pivot_input(c), ["area", "grp"], value="met_sla", agg="avg"),
            "met_sla",
        )
    ),
    "pivot_distinct": _on_cases(lambda c: _distinct(c, "count_distinct")),
    "pivot_distinct_sketch": _on_cases(_sketched),
    "frequent_ci": _on_cases(lambda c: pivot.frequent_ci(c, FREQUENT_SHARE)),
    "frequent_ci_tree": _on_cases(
        lambda c: pivot.frequent_ci_tree(pivot.frequent_ci(c, FREQUENT_SHARE))
    ),
    "state_matrix": _on_cases(pivot.state_matrix),
    "state_matrix_area": _on_cases(lambda c: pivot.state_matrix(c, AREA)),
    "recurrent_cases": _on_pending(lists.recurrent_cases),
    "recurrent_cases_area": _on_pending(lambda p: lists.recurrent_cases(p, AREA)),
    "distinct_pairs": _on_cases(lambda c: lists.distinct_pairs(c, ["specialist", "area"])),
    "dedup_cases": _first_cases("case_id"),
    "dedup_cases_in_place": _first_cases("l_orderkey", "l_linenumber"),
    # Time series
    "hourly_arrivals": _on_cases(_arrivals()),
    "hourly_arrivals_area": _on_cases(_arrivals(area=AREA)),
    "hourly_incidents": _on_cases(_arrivals(case_type="INCIDENT")),
    "hourly_requests": _on_cases(_arrivals(case_type="REQUEST")),
    "business_grid": _grid,
    "backlog_trend": _on_cases(_trend),
    "backlog_ratios": _on_cases(lambda c: series.backlog_ratios(_trend(c))),
    "running_compliance": _on_cases(
        lambda c: _rounded(series.running_compliance(c), "ics_pct")
    ),
    "running_compliance_total": _on_cases(
        lambda c: _rounded(series.running_compliance(c, series="TOTAL"), "ics_pct")
    ),
    "running_compliance_area": _on_cases(
        lambda c: _rounded(series.running_compliance(c, series=AREA), "ics_pct")
    ),
    "rolling_arrivals": _on_cases(
        lambda c: _rounded(
            series.rolling_mean(
                _arrivals()(c), "hour", ["incidents", "requests", "total"], ROLL
            ),
            "incidents",
            "requests",
            "total",
        )
    ),
    # Top lists
    "top_specialists": _on_cases(lists.top_specialists),
    "top_sites": _on_cases(lists.top_sites),
    # Flows
    "flow_incidents": _on_cases(
        lambda c: flows.category_flow(c, "INCIDENT", tag_level_2=False)
    ),
    "flow_requests": _on_cases(lambda c: flows.category_flow(c, "REQUEST")),
    "flow_missed_incidents": _on_cases(
        lambda c: flows.category_flow(c, "INCIDENT", missed_only=True)
    ),
    "flow_missed_requests": _on_cases(
        lambda c: flows.category_flow(c, "REQUEST", missed_only=True)
    ),
    "flow_open": _on_cases(flows.open_flow),
    "flow_ci_state": _on_cases(flows.ci_state_flow),
    "flow_client_pending": _on_pending(flows.client_pending_flow),
    "flow_client_pending_area": _on_pending(lambda p: flows.client_pending_flow(p, AREA)),
    # Scalar functions
    "split_category": _on_cases(_split),
    "fold_accents": _folded,
    "blank_labels": _on_cases(_blank_labels),
    "parse_progress": _on_cases(_progress),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["kpi_scorecard"](spark, sf_dir)
