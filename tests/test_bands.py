from datetime import date

import pytest
from pyspark.sql import functions as F

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.operators import bands, kpi


def band(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])
    return row.select(column.alias("b")).first().b


@pytest.mark.parametrize(
    "value, expected",
    [(0.49, "red"), (0.5, "none"), (0.51, "orange"), (0.75, "orange"), (0.76, "green"), (None, "none")],
)
def test_target(spark, value, expected):
    # 0.75 and 0.25 are exact in binary, so the edge 0.5 is hit exactly.
    assert band(spark, bands.target_band("v", "t", "d"), v=value, t=0.75, d=0.25) == expected


def test_without_target_there_is_no_band(spark):
    assert band(spark, bands.target_band("v", "t", "d"), v=0.9, t=None, d=None) == "none"


@pytest.mark.parametrize(
    "value, expected",
    [
        (0.39, "red"),
        (0.4, "none"),
        (0.41, "orange"),
        (0.5, "orange"),
        (0.51, "green"),
        (1.0, "none"),
        (1.01, "red"),
        (None, "none"),
    ],
)
def test_speed(spark, value, expected):
    assert band(spark, bands.speed_band("v"), v=value) == expected


@pytest.mark.parametrize(
    "value, expected", [(94.9, "green"), (95.0, "none"), (95.1, "red"), (200.0, "red"), (None, "none")]
)
def test_quota(spark, value, expected):
    assert band(spark, bands.quota_band("v"), v=value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [(101, "red"), (100, "orange"), (91, "orange"), (90, "none"), (89, "green"), (None, "none")],
)
def test_capacity(spark, value, expected):
    assert band(spark, bands.capacity_band("v", "p"), v=value, p=100) == expected


@pytest.mark.parametrize("value, expected", [(5, "red"), (6, "red"), (4, "green"), (None, "none")])
def test_missed(spark, value, expected):
    assert band(spark, bands.missed_band("v", "n"), v=value, n=5) == expected


def test_targets_of_any_number(spark, make_cases):
    cases = make_cases(dict(area="A7", inclusion="INCLUDED", met_sla=1, closed_in_period=1, elapsed_minutes=1, sla_minutes=1))
    capacity = spark.createDataFrame([], schema.CAPACITY)
    targets = [(f"A{i}", kpi_name, 0.5, 0.1) for i in range(10_000) for kpi_name in ("ics", "ies")]
    table = spark.createDataFrame(targets, "area string, kpi string, target double, tolerance double")
    for given in (targets, table):
        bands_of = {r.area: r.ics_band for r in kpi.scorecard(cases, capacity, date(2016, 6, 1), given).collect()}
        assert bands_of["A7"] == "green"
    assert len(fv.TARGETS) == 10


def test_indicator_values(make_cases):
    cases = make_cases(
        dict(area="A", inclusion="INCLUDED", met_sla=1, closed_in_period=1, elapsed_minutes=30, sla_minutes=60),
        dict(area="A", inclusion="INCLUDED", met_sla=0, closed_in_period=1, elapsed_minutes=60, sla_minutes=60),
        dict(area="A", inclusion="EXCLUDED", met_sla=1, closed_in_period=1, due_in_month=1),
        dict(area="B", inclusion="EXCLUDED", met_sla=1, solved_pending_close=1, overdue_prev_months=1,
             closed_early_prev=1),
    )
    ics = {r.area: r.ics for r in kpi.kpi_compliance(cases, ["area"]).collect()}
    assert ics == {"A": 0.5, "TOTAL": 0.5}
    ivs = {r.area: r.ivs for r in kpi.kpi_speed(cases, ["area"]).collect()}
    assert ivs == {"A": 0.75, "B": None, "TOTAL": 0.75}
    ies = {r.area: r.ies for r in kpi.kpi_effectiveness(cases, ["area"]).collect()}
    assert ies == {"A": 3.0, "B": None, "TOTAL": 4.0}
    assert kpi.kpi_compliance(cases).first().ics == 0.5
    missed = {r.area: r for r in kpi.kpi_missed(cases, ["area"]).collect()}
    assert (missed["TOTAL"].missed, missed["TOTAL"].missed_pct) == (1, 25.0)
    assert (missed["TOTAL"].missed_limit, missed["TOTAL"].missed_band) == (0, "red")


def test_a_unit_that_is_null_is_not_the_total(make_cases):
    cases = make_cases(dict(area=None, met_sla=0), dict(area="A", met_sla=1))
    rows = {r.area: r.missed for r in kpi.kpi_missed(cases, ["area"]).collect()}
    assert rows == {None: 1, "A": 0, "TOTAL": 1}
