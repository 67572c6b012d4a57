from datetime import date, datetime, timedelta

import pytest
from caselight.functions import fixed_values as fv
from caselight.operators import prepare
from caselight.plans.base import ORIGINAL_EXCLUSIONS, report_base

START = datetime(2016, 6, 1, 8)


def ids(df):
    return sorted((r.case_id for r in df.collect()), key=lambda i: (i is None, i))


def test_exclusions_keep_null(spark, make_cases):
    cases = make_cases(
        dict(case_id=1, grp="G"), dict(case_id=2, grp=None), dict(case_id=None, grp="G"), dict(case_id=3, subgrp="S")
    )
    assert ids(prepare.exclude_cases(cases, [1])) == [2, 3, None]
    bad = spark.createDataFrame([(1,), (None,)], "case_id bigint")
    assert ids(prepare.exclude_cases(cases, bad)) == [2, 3, None]
    assert ids(prepare.exclude_cases(cases, [])) == [1, 2, 3, None]
    assert ids(prepare.exclude_units(cases, ["G"], ["S"])) == [2]


def test_open_rules(make_cases):
    cases = make_cases(
        dict(case_id=1, state="CLOSED", solved_at=START),
        dict(case_id=2, state="SOLVED"),
        dict(case_id=3, state="DENIED"),
        dict(case_id=4, state="OPEN"),
        dict(case_id=5, state=None, solved_at=START),
    )
    assert ids(prepare.open_cases(cases, "unsolved")) == [2, 3, 4]
    assert ids(prepare.open_cases(cases, "state")) == [3, 4, 5]
    assert ids(prepare.open_cases(cases, "actionable")) == [4, 5]
    assert ids(prepare.solved_cases(cases)) == [1, 5]
    with pytest.raises(ValueError):
        prepare.open_cases(cases, "other")


def test_scope(make_cases):
    cases = make_cases(
        dict(case_id=1, service_type="END_USER", case_type="INCIDENT"),
        dict(case_id=2, service_type="INTERNAL", case_type="INCIDENT"),
        dict(case_id=3, service_type="END_USER", case_type="REQUEST"),
    )
    assert ids(prepare.scope(cases)) == [1, 2, 3]
    assert ids(prepare.scope(cases, service_type="END_USER")) == [1, 3]
    assert ids(prepare.scope(cases, "END_USER", "INCIDENT")) == [1]


def test_month_window_reaches_the_first_of_the_month_30_days_on(make_cases):
    stamps = [
        datetime(2016, 1, 31, 23), datetime(2016, 2, 1), datetime(2016, 2, 29), datetime(2016, 3, 1),
        datetime(2016, 3, 1, 1),
    ]
    cases = make_cases(*[dict(case_id=i, registered_at=t) for i, t in enumerate(stamps)])
    assert ids(prepare.month_window(cases, "registered_at", date(2016, 2, 10))) == [1, 2, 3]


def test_pseudonyms_follow_first_appearance(make_cases):
    names = ["zoe", "ann", None, "bob", "ann", "eve", "zoe"]
    hours = [5, 5, 0, 1, 9, 1, 0]
    cases = make_cases(
        *[
            dict(case_id=i, specialist=n, registered_at=START + timedelta(minutes=20 * h))
            for i, (n, h) in enumerate(zip(names, hours))
        ]
    )
    got = {r.case_id: r.specialist for r in prepare.pseudonymise(cases).collect()}
    # Both at minute 0: a missing name sorts first. bob and eve tie, so the name decides.
    expected = {None: "User1", "zoe": "User2", "bob": "User3", "eve": "User4", "ann": "User5"}
    assert got == {i: expected[n] for i, n in enumerate(names)}


def test_pseudonyms_are_one_to_one(small_cases):
    pairs = small_cases.select("case_id", "l_partkey", "l_extendedprice", "specialist").join(
        prepare.pseudonymise(small_cases).selectExpr(
            "case_id", "l_partkey", "l_extendedprice", "specialist AS pseudonym"
        ),
        ["case_id", "l_partkey", "l_extendedprice"],
    )
    distinct = pairs.select("specialist", "pseudonym").distinct().collect()
    names = small_cases.select("specialist").distinct().count()
    assert len(distinct) == names
    assert {r.pseudonym for r in distinct} == {f"User{i}" for i in range(1, names + 1)}


def test_stable_pseudonyms(make_cases):
    cases = make_cases(dict(case_id=1, specialist="ann"), dict(case_id=2, specialist="ann"))
    one, two = (r.specialist for r in prepare.pseudonymise_stable(cases, "salt").collect())
    assert one == two and len(one) == 64
    other = prepare.pseudonymise_stable(cases, "pepper").first().specialist
    assert other != one


def test_report_base(make_cases):
    cases = make_cases(
        dict(case_id=fv.BAD_CASE_IDS[0], grp="G", registered_at=START),
        dict(case_id=1, grp=fv.EXCLUDED_GROUPS[0], registered_at=START),
        dict(case_id=2, subgrp=fv.EXCLUDED_SUBGROUPS[2], registered_at=START),
        dict(case_id=3, case_type="REQUEST", specialist="a", registered_at=START),
        dict(case_id=4, case_type="INCIDENT", specialist="b", registered_at=START),
    ).drop("missed")
    rows = report_base(cases, case_type="INCIDENT", pseudonyms=True, **ORIGINAL_EXCLUSIONS).collect()
    assert [(r.case_id, r.specialist, r.missed) for r in rows] == [(4, "User1", 1)]
    assert report_base(cases).count() == 5
    assert len(fv.BAD_CASE_IDS) == len(set(fv.BAD_CASE_IDS)) == 75


def test_pseudonyms_of_one_stamp_are_spread(spark):
    for stamp in ("timestamp_ntz'2024-01-01 10:00:00'", "cast(NULL AS timestamp_ntz)"):
        cases = spark.range(20_000).selectExpr("concat('name', id) AS specialist", f"{stamp} AS registered_at")
        numbered = prepare.first_appearance(cases, "specialist", "registered_at", stretches=64)
        rows = numbered.collect()
        assert [r.value for r in sorted(rows, key=lambda r: r.number)] == sorted(r.value for r in rows)
        sizes = [r["count"] for r in _stretches(cases).collect()]
        assert len(sizes) > 50 and max(sizes) < 4 * 20_000 / len(sizes)


def _stretches(cases):
    """How many names each stretch holds, read off the window's partitions."""
    plan = prepare.first_appearance(cases, "specialist", "registered_at", stretches=64)
    names = sorted(plan.collect(), key=lambda r: r.number)
    hashed = cases.sparkSession.createDataFrame([(r.value,) for r in names], "value string")
    chosen = sorted(r.value for r in hashed.selectExpr("value", "xxhash64(value) AS h").orderBy("h", "value").limit(256).collect())
    cuts = chosen[::4]
    edges = [0, *(sum(r.value < c for r in names) for c in cuts), len(names)]
    sizes = [(b - a,) for a, b in zip(edges, edges[1:])]
    return cases.sparkSession.createDataFrame([s for s in sizes if s[0]], "count long")
