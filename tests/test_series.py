from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from caselight.operators import series
from caselight.plans.catalog import AS_OF, HOLIDAYS

# 1 June 2016 is a Wednesday, 4 and 5 June a weekend, 6 June a listed holiday.
DAY = date(2016, 6, 7)


def grid_points(as_of, holidays):
    t = datetime(as_of.year, as_of.month, 1)
    end = datetime(as_of.year, as_of.month, as_of.day) + timedelta(days=1)
    while t <= end:
        if t.weekday() < 5 and t.date() not in holidays:
            yield t
        t += timedelta(hours=1)


def test_grid(spark):
    got = [r.t for r in series.business_grid(spark, DAY).orderBy("t").collect()]
    assert got == list(grid_points(DAY, {date(2016, 6, 6)}))
    days = {t.day for t in got}
    assert days == {1, 2, 3, 7, 8}
    none = [r.t for r in series.business_grid(spark, DAY, []).collect()]
    assert date(2016, 6, 6) in {t.date() for t in none}


def test_trend_is_strict_and_counts_dropped_hours(make_cases):
    early, late = datetime(2016, 5, 20), datetime(2016, 6, 2)
    stamps = [
        datetime(2016, 6, 1, 9, 59, 59), datetime(2016, 6, 1, 10, 0, 0), datetime(2016, 6, 1, 10, 0, 1),
        datetime(2016, 6, 4, 12), early,
    ]
    cases = make_cases(
        *[dict(case_id=i, registered_at=t, due_at=late) for i, t in enumerate(stamps)],
        # Due at the last business hour itself: not counted at all.
        dict(case_id=9, registered_at=early, due_at=datetime(2016, 6, 8)),
        dict(case_id=10, registered_at=early, due_at=None),
    )
    rows = {r.t: r for r in series.backlog_trend(cases, DAY).collect()}
    assert rows[datetime(2016, 6, 1, 0)].registered == 1
    assert rows[datetime(2016, 6, 1, 9)].registered == 1
    assert rows[datetime(2016, 6, 1, 10)].registered == 2
    assert rows[datetime(2016, 6, 1, 11)].registered == 4
    # The Saturday event shows on the next business day.
    assert rows[datetime(2016, 6, 3, 23)].registered == 4
    assert rows[datetime(2016, 6, 7, 0)].registered == 5
    assert datetime(2016, 6, 4, 13) not in rows
    # Nothing solved: no lag while nothing is due, undefined afterwards.
    assert rows[datetime(2016, 6, 1, 0)].lag_pct == 0.0
    assert rows[datetime(2016, 6, 7, 0)].lag_pct is None
    assert rows[datetime(2016, 6, 7, 0)].managed_pct == 0.0


def test_trend_against_brute_force(small_cases):
    rows = series.backlog_trend(small_cases, AS_OF, HOLIDAYS).orderBy("t").collect()
    points = list(grid_points(AS_OF, set(HOLIDAYS)))
    assert [r.t for r in rows] == points
    events = [
        (r.registered_at, r.solved_at, r.due_at)
        for r in small_cases.select("registered_at", "solved_at", "due_at").collect()
        if r.due_at < points[-1]
    ]
    for r in rows[:: len(rows) // 20]:
        counts = tuple(sum(e[i] is not None and e[i] < r.t for e in events) for i in range(3))
        assert (r.registered, r.solved, r.due) == counts
        assert r.open == r.registered - r.solved
    for before, after in zip(rows, rows[1:]):
        assert all(before[c] <= after[c] for c in ("registered", "solved", "due"))


def test_trend_takes_the_day_from_the_data(spark, small_cases):
    day = series.latest_day(small_cases, until=AS_OF)
    assert day.first().as_of <= AS_OF
    fixed = series.backlog_trend(small_cases, day.first().as_of, HOLIDAYS).collect()
    derived = series.backlog_trend(small_cases, day, HOLIDAYS).collect()
    assert sorted(map(str, fixed)) == sorted(map(str, derived))
    assert spark


def test_arrivals(make_cases):
    t = datetime(2016, 6, 1, 9)
    cases = make_cases(
        dict(case_id=1, case_type="INCIDENT", registered_at=t + timedelta(minutes=5)),
        dict(case_id=1, case_type="REQUEST", registered_at=t + timedelta(hours=3)),
        dict(case_id=2, case_type="INCIDENT", registered_at=t + timedelta(minutes=59)),
        dict(case_id=3, case_type="REQUEST", registered_at=t + timedelta(hours=1)),
    )
    got = [tuple(r) for r in series.hourly_arrivals(cases).orderBy("hour").collect()]
    assert got == [(t, 2, None, 2), (t + timedelta(hours=1), None, 1, 1)]
    only = [tuple(r) for r in series.hourly_arrivals(cases, case_type="REQUEST").orderBy("hour").collect()]
    # The scope comes before the repeated id is dropped.
    assert only == [(t + timedelta(hours=1), 1), (t + timedelta(hours=3), 1)]


def test_running_compliance(small_cases):
    per_day = defaultdict(lambda: [0, 0, 0])
    for r in small_cases.filter("inclusion = 'INCLUDED' AND solved_at IS NOT NULL").collect():
        for area in (r.area, "TOTAL"):
            sums = per_day[area, r.solved_at.date()]
            for i, v in enumerate((r.missed, r.met_sla, r.closed_in_period)):
                sums[i] += v
    days = sorted({d for _, d in per_day})
    expected = {}
    for area in {a for a, _ in per_day}:
        totals = [0, 0, 0]
        seen = False
        for day in days:
            seen = seen or (area, day) in per_day
            totals = [a + b for a, b in zip(totals, per_day.get((area, day), (0, 0, 0)))]
            if seen:
                ics = 100 * totals[1] / totals[2] if totals[2] else None
                expected[area, day] = (totals[0], ics and round(ics, 9))
    got = {
        (r.area, r.solved_on): (r.missed, r.ics_pct and round(r.ics_pct, 9))
        for r in series.running_compliance(small_cases).collect()
    }
    assert got == expected
    total = series.running_compliance(small_cases, series="TOTAL")
    assert {r.solved_on for r in total.collect()} == set(days)
    assert total.select("area").distinct().count() == 1


def test_rolling_mean(spark):
    rows = [("x", 1, 2.0), ("x", 2, None), ("x", 3, 4.0), ("x", 4, 9.0), ("y", 1, 7.0)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    got = series.rolling_mean(df, "t", ["v"], 3, ["s"]).orderBy("s", "t").collect()
    assert [r.v for r in got] == [2.0, 2.0, 3.0, 6.5, 7.0]
    same = series.rolling_mean(df.filter(F.col("s") == "x"), "t", ["v"], 1).orderBy("t").collect()
    assert [r.v for r in same] == [2.0, None, 4.0, 9.0]


def test_running_compliance_needs_no_more_than_areas_times_days(spark):
    cases = spark.range(60_000).selectExpr(
        "concat('a', id % 200) AS area", "'INCLUDED' AS inclusion",
        "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(cast(id / 200 AS int)) AS solved_at",
        "0 AS missed", "1 AS met_sla", "1 AS closed_in_period",
    )
    table = series.running_compliance(cases)
    table.collect()
    node = table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == 201 * 300 and "Generate" in node
    entries = 0
    plan, stack = table._jdf.queryExecution().executedPlan(), []
    stack.append(plan)
    while stack:
        p = stack.pop()
        if p.nodeName() == "Generate":
            entries = max(entries, p.metrics().apply("numOutputRows").value())
        for f in ("executedPlan", "plan"):
            try:
                stack.append(getattr(p, f)())
            except Exception:  # noqa: BLE001
                pass
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert 0 < entries <= 3 * 201 * 300


def test_running_compliance_over_a_long_calendar(make_cases):
    """Days before 1970 and far ahead, areas without a name, and buckets without a solve day."""
    days = [datetime(1969, 12, 30), datetime(1970, 1, 2), datetime(2016, 6, 5), datetime(9999, 12, 31)]
    rows = [
        dict(area="A", solved_at=days[1]), dict(area="A", solved_at=days[3]),
        dict(area=None, solved_at=days[0]), dict(area="B", solved_at=days[2]),
    ]
    cases = make_cases(*[{**r, "inclusion": "INCLUDED", "met_sla": 0, "closed_in_period": 1} for r in rows])
    got = {(r.area, r.solved_on.year): r.missed for r in series.running_compliance(cases).collect()}
    assert got == {
        (None, 1969): 1, (None, 1970): 1, (None, 2016): 1, (None, 9999): 1,
        ("A", 1970): 1, ("A", 2016): 1, ("A", 9999): 2, ("B", 2016): 1, ("B", 9999): 1,
        ("TOTAL", 1969): 1, ("TOTAL", 1970): 2, ("TOTAL", 2016): 3, ("TOTAL", 9999): 4,
    }
    assert series.running_compliance(cases.limit(0)).count() == 0
