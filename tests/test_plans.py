"""What the physical plans must and must not contain."""

import re
from functools import cache

import pytest
from conftest import SMALL

from caselight.operators import prepare
from caselight.plans.catalog import QUERIES
from caselight.sources import star_tables


@cache
def plan(spark, name):
    df = QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas", "InArrow"):
        assert bad not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_ordered_windows_work_on_aggregates(spark, name):
    """A window without partition may only see rows that were aggregated before."""
    lines = plan(spark, name).splitlines()
    for i, line in enumerate(lines):
        found = re.search(r"[-+] Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", line)
        if not found:
            continue
        # Partition columns come first; without any, the ordering or the frame does.
        first = found.group(1).strip()
        if first == "" or re.match(r"\S+ (ASC|DESC)", first):
            assert any("HashAggregate" in later for later in lines[i + 1 :])
            assert not re.search(r"FileScan", "\n".join(lines[i + 1 : i + 4]))


@pytest.mark.parametrize("name", ["dedup_cases", "hourly_arrivals"])
def test_first_row_is_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text


@pytest.mark.parametrize("name", ["detail_specialist_category", "detail_area", "frequent_ci"])
def test_share_of_total_reuses_the_shuffle(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange \[area", text)


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(spark, "scope_service")
    assert "l_shipdate" not in text and "o_totalprice" not in text
    narrow = plan(spark, "distinct_pairs")
    scan = next(line for line in narrow.splitlines() if "lineitem.parquet" in line)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>", scan)
    pending = plan(spark, "recurrent_cases")
    assert "EqualTo(l_returnflag,R)" in pending


def test_a_stored_snapshot_is_filtered_in_the_scan(spark, tmp_path):
    from caselight.operators import detail, kpi, prepare
    from caselight.sources import readers, star_tables

    path = str(tmp_path / "snapshot")
    readers_cases = star_tables.cases(spark, SMALL).select(*readers.schema.CASE_COLUMNS)
    readers_cases.write.parquet(path)
    cases = prepare.with_missed(readers.read_snapshot(spark, path))
    text = kpi.kpi_compliance(prepare.by_area(cases, "ASIA"), ["area"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(area,ASIA)" in text and "EqualTo(inclusion,INCLUDED)" in text
    assert "ReadSchema: struct<area:string,inclusion:string,met_sla:int,closed_in_period:int>" in text
    part = detail.indicator_detail(cases, "area", "ASIA")
    assert "EqualTo(area,ASIA)" in part._jdf.queryExecution().executedPlan().toString()


def test_an_area_is_chosen_before_lines_meet_orders(spark):
    cases = prepare.by_area(star_tables.cases(spark, SMALL), "ASIA")
    plan = cases._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {
        key: next(line.index("Join") for line in plan if "Join" in line and f"({key}#" in line)
        for key in ("l_suppkey", "l_orderkey", "n_regionkey")
    }
    assert depth["l_orderkey"] < depth["l_suppkey"] < depth["n_regionkey"]


def _final(df):
    """The final plan alone, without the plans it grew from."""
    df.collect()
    kept, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "== Initial Plan ==" in line else None
        if hidden is None:
            kept.append(line)
    return "\n".join(kept)


def _snapshot(spark, tmp_path):
    from caselight.sources import readers

    path = str(tmp_path / "snapshot")
    star_tables.cases(spark, SMALL).select(*readers.schema.CASE_COLUMNS).write.parquet(path)
    return prepare.with_missed(readers.read_snapshot(spark, path))


@pytest.mark.parametrize("level", ["area", "subgroup", "specialist_category", "service_category", "total"])
def test_share_of_total_of_one_area_from_one_scan(spark, tmp_path, level):
    from caselight.operators import detail

    cases = _snapshot(spark, tmp_path)
    shared = detail.indicator_detail(cases, level, "ASIA", ordered=False, shared_scan=True)
    apart = detail.indicator_detail(cases, level, "ASIA", ordered=False)
    assert sorted(map(str, shared.collect())) == sorted(map(str, apart.collect()))
    if level != "total":
        text = _final(shared)
        assert text.count("FileScan parquet") == 1 and "ReusedExchange" in text
        assert shared.count() > 0


def _below(text, node):
    """The part of a plan under the first line with that node."""
    lines = text.splitlines()
    depths = [len(line) - len(line.lstrip(" :|+-*(0123456789)")) for line in lines]
    at = next(i for i, line in enumerate(lines) if node in line)
    end = next((i for i in range(at + 1, len(lines)) if depths[i] <= depths[at]), len(lines))
    return "\n".join(lines[at:end])


@pytest.mark.parametrize("name, shuffles", [("dedup_cases", 3), ("dedup_cases_in_place", 2)])
def test_first_rows_are_chosen_before_texts_are_joined(spark, name, shuffles):
    below = _below(plan(spark, name), "Window [")
    # Lines and orders are brought together; by their own key the lines then need no third shuffle.
    assert below.count("- Exchange") == shuffles
    assert "hashpartitioning(l_orderkey" in below and "lineitem.parquet" in below
    assert not any(text in below for text in ("p_name", "s_name", "c_name", "r_name"))


@pytest.mark.parametrize("name", ["running_compliance", "running_compliance_area"])
def test_running_compliance_gathers_no_area_days(spark, name):
    text = plan(spark, name)
    singles = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    # The only rows that meet in one place are the last buckets of the tasks.
    after = [text.splitlines()[text.splitlines().index(line) + 1] for line in singles]
    assert all("partial_max" in line for line in after)
    assert "collect_set" not in text
