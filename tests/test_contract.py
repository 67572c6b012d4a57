"""Reports refuse tables that were delivered without a column they need."""

import pytest

from caselight import schema
from caselight.functions import contract
from caselight.operators import capacity, detail, flows, kpi, lists, pivot, series
from caselight.plans.base import report_base
from caselight.sources import readers, writers
from datetime import date

HEADER = "Caso;AREA;Fecha de registro;Fecha real de solución;Fecha de vencimiento;Especialista;Estado;GRUPO"
ROW = "1;A;05/06/2016 09:08:07;;07/06/2016 10:00:00;Ana;Cerrado;G"


@pytest.fixture
def narrow(spark, tmp_path):
    """A delivery without ``met_sla`` and many others, read and prepared."""
    path = tmp_path / "cases.csv"
    path.write_text(f"{HEADER}\n{ROW}\n", encoding="latin1")
    return str(path)


def _refused(make):
    with pytest.raises(contract.MissingColumns) as told:
        make()
    return str(told.value)


def test_a_misspelt_header_stops_the_report_and_not_the_reading(spark, narrow):
    base = report_base(readers.read_cases(spark, narrow), service_type=None)
    assert base.count() == 1
    assert "met_sla" in _refused(lambda: kpi.kpi_compliance(base, ["area"]))
    assert "missed" in _refused(lambda: kpi.kpi_missed(base))
    assert "closed_in_period" in _refused(lambda: detail.indicator_detail(base, "specialist"))
    assert "category_path" in _refused(lambda: flows.category_flow(base, "INCIDENT"))
    assert "ci" in _refused(lambda: pivot.frequent_ci(base))
    assert "level_1" in _refused(lambda: pivot.pivot_summary(pivot.pivot_input(base), ["level_1"], value="area", agg="count"))
    assert "due_in_month" in _refused(lambda: capacity.active_backlog(base))
    assert "site" in _refused(lambda: lists.worklist(base))
    caps = spark.createDataFrame([], schema.CAPACITY)
    assert "closed_in_period" in _refused(lambda: kpi.scorecard(base, caps, date(2016, 6, 1)))
    # What was delivered is reported.
    assert series.backlog_trend(base, date(2016, 6, 15)).count() > 0
    assert [tuple(r) for r in flows.open_flow(base.filter("area = 'A'")).collect()] == []


def test_no_job_runs_before_the_refusal(spark, narrow):
    base = report_base(readers.read_cases(spark, narrow))
    spark.sparkContext.setJobGroup("refusal", "")
    try:
        _refused(lambda: kpi.kpi_compliance(base))
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("refusal") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_mark_stays_through_the_store_and_through_plans(spark, narrow, tmp_path):
    target = str(tmp_path / "store")
    writers.refresh_snapshot(spark, narrow, target, reject_limit=0)
    stored = readers.read_snapshot(spark, target)
    assert "met_sla" in contract.absent(stored) and "area" not in contract.absent(stored)
    kept = stored.filter("case_id = 1").join(spark.range(3).withColumnRenamed("id", "case_id"), "case_id")
    assert "met_sla" in contract.absent(kept.select("case_id", "met_sla"))
    assert "met_sla" in _refused(lambda: kpi.kpi_compliance(kept))


def test_reports_that_can_be_made(spark, narrow, make_cases):
    lacking = contract.reports_without_columns(report_base(readers.read_cases(spark, narrow)))
    assert "met_sla" in lacking["kpi_compliance"] and "backlog_trend" not in lacking
    whole = contract.reports_without_columns(make_cases({"area": "A"}))
    assert whole == {}


def test_every_needed_column_is_known(small_cases):
    for needed in contract.NEEDS.values():
        assert not contract.missing(small_cases, needed)
