from datetime import date, datetime

from caselight import schema
from caselight.operators import capacity as cap
from caselight.operators import kpi

AS_OF = date(2016, 6, 15)
DONE = datetime(2016, 6, 2)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schema.CAPACITY)


def open_row(area, **more):
    return dict(area=area, met_sla=1, **more)


def solved_row(area):
    return dict(area=area, met_sla=1, solved_at=DONE)


def by_area(df):
    return {r.area: r for r in df.collect()}


def test_outlook(spark, make_cases):
    capacity = table(
        spark, ("A", 1, 10.0), ("A", 15, 3.0), ("B", 1, 8.0), ("B", 15, 5.0), ("C", 1, 4.0),
        ("C", 15, 1.0), ("A", 16, 99.0),
    )
    cases = make_cases(
        open_row("A", due_in_month=1), open_row("A", due_in_month=1, overdue_prev_months=1),
        open_row("A", overdue_prev_months=1), open_row("A"), solved_row("A"), solved_row("A"),
        open_row("B"), solved_row("B"),
        open_row("C"),
        open_row("D"), solved_row("D"),
    )
    rows = by_area(cap.capacity_outlook(cases, capacity, AS_OF))
    # C has nothing solved and D no capacity: both drop out.
    assert set(rows) == {"A", "B", "TOTAL"}
    a, b, t = rows["A"], rows["B"], rows["TOTAL"]
    assert (a.total, a.due, a.p0, a.probability, a.spare) == (4, 4, 3.0, 75.0, -1.0)
    assert (a.cap_total, a.solved, a.quota_pct) == (10.0, 2, 20.0)
    # Nothing due: the chance is full.
    assert (b.due, b.probability, b.spare, b.quota_pct) == (0, 100.0, 5.0, 12.5)
    assert (t.total, t.due, t.p0, t.probability, t.spare) == (5, 4, 8.0, 87.5, 4.0)
    assert (t.cap_total, t.solved, t.quota_pct) == (18.0, 3, 16.25)
    bands = {r.area: r.to_close_band for r in kpi.kpi_to_close(cap.capacity_outlook(cases, capacity, AS_OF)).collect()}
    assert bands == {"A": "red", "B": "green", "TOTAL": "green"}


def test_chance_is_capped_and_undefined_without_capacity(spark, make_cases):
    capacity = table(spark, ("A", 1, 9.0), ("A", 15, 9.0), ("B", 1, 0.0), ("B", 15, 0.0))
    cases = make_cases(
        open_row("A", due_in_month=1), solved_row("A"), open_row("B"), solved_row("B")
    )
    rows = by_area(cap.capacity_outlook(cases, capacity, AS_OF))
    assert rows["A"].probability == 100.0
    assert (rows["B"].probability, rows["B"].quota_pct) == (None, None)


def test_no_open_case_gives_constants(spark, make_cases):
    capacity = table(spark, ("A", 1, 10.0), ("A", 15, 3.0), ("B", 1, 10.0), ("B", 15, 3.0))
    cases = make_cases(solved_row("A"), solved_row("X"))
    rows = by_area(cap.capacity_outlook(cases, capacity, AS_OF))
    assert set(rows) == {"A", "B", "TOTAL"}
    for r in rows.values():
        assert tuple(r)[1:] == (0, 0, 1.0, 100.0, 0.0, 0.0, 0, 100.0)
    empty = by_area(cap.capacity_outlook(cases.limit(0), capacity, AS_OF))
    assert set(empty) == {"A", "B", "TOTAL"}
    card = by_area(kpi.scorecard(cases, capacity, AS_OF))
    assert (card["A"].due, card["A"].p0, card["A"].to_close_band) == (0, 1.0, "green")
    assert (card["A"].solved, card["A"].quota_pct, card["A"].solved_band) == (0, 100.0, "red")


def test_joins(spark, make_cases):
    capacity = table(spark, ("A", 15, 3.0), ("B", 15, 1.0), ("A", 1, 7.0))
    cases = make_cases(open_row("A"), open_row("X"))
    joined = cap.join_capacity(cap.backlog_by_area(cases), capacity, AS_OF).collect()
    assert [(r.area, r.total, r.p0) for r in joined] == [("A", 1, 3.0)]


def test_active_backlog(make_cases):
    cases = make_cases(
        dict(area="A", specialist="s", due_in_month=1, met_sla=0),
        dict(area="A", specialist="s", met_sla=1),
        dict(area="A", specialist="s", solved_at=DONE),
    )
    rows = cap.active_backlog(cases).collect()
    assert [(r.specialist, r.active, r.due, r.missed) for r in rows] == [("s", 2, 1, 1)]


def test_scorecard_agrees_with_single_indicators(spark, small_cases):
    from caselight.plans import catalog
    from caselight.sources import star_tables
    from conftest import SMALL

    capacity = star_tables.capacity(spark, SMALL)
    card = by_area(kpi.scorecard(small_cases, capacity, catalog.AS_OF, catalog.TARGETS))
    for table_, names in (
        (kpi.kpi_compliance(small_cases, ["area"]), ["ics"]),
        (kpi.kpi_speed(small_cases, ["area"]), ["ivs"]),
        (kpi.kpi_effectiveness(small_cases, ["area"]), ["ies"]),
        (kpi.kpi_missed(small_cases, ["area"]), ["missed", "missed_pct", "missed_limit"]),
    ):
        for area, row in by_area(table_).items():
            assert [row[n] for n in names] == [card[area][n] for n in names]
    total_only = kpi.kpi_speed(small_cases).first()
    assert total_only.ivs == card["TOTAL"].ivs


def test_repeated_capacity_rows_do_not_multiply_the_backlog(spark, make_cases):
    cases = make_cases({"area": "A"}, {"area": "A"}, {"area": "B"})
    rows = [("A", 15, 3.0), ("A", 15, 7.0), ("A", 15, None), ("B", 14, 1.0), ("B", 15, 2.0)]
    caps = spark.createDataFrame(rows, schema.CAPACITY)
    backlog = cap.backlog_by_area(cases).select("area", "total")
    joined = cap.join_capacity(backlog, caps, date(2016, 6, 15)).collect()
    assert sorted(tuple(r) for r in joined) == [("A", 2, 7.0), ("B", 1, 2.0)]
