"""A delivery is written once, parsed once, and its stamps are read once."""

import re
import uuid
from collections import Counter
from datetime import datetime, timedelta
from itertools import product
from random import Random

import pytest

from caselight import schema
from caselight.plans import deliveries
from caselight.sources import intake, readers, star_tables, store, writers

HEADER = "Caso;AREA;Cumplió SLA;Fecha de registro;Fecha de vencimiento;Fecha real de solución"
ROWS = ("1;A;1;05/06/2016 09:08:07;06/06/2016 09:00:00;", "2;A;no;nonsense;;", "3;A;1;05/06/2016 09:08:07;;")


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n", encoding="latin1")
    return str(path)


def test_rejects_are_written_with_the_rows(spark, source, tmp_path, monkeypatch):
    def parsed_again(self):
        raise AssertionError("the delivery is parsed a second time")

    monkeypatch.setattr(intake.Delivered, "rejects", property(parsed_again))
    target = str(tmp_path / "store")
    version = writers.refresh_snapshot(spark, source, target, reject_limit=1)
    assert (version.n_rows, version.n_rejected) == (2, 1)
    assert sorted(r.case_id for r in readers.read_snapshot(spark, target).collect()) == [1, 3]
    told = writers.read_rejects(spark, target).collect()
    assert [(r.row_text, r.reason) for r in told] == [
        ("2;A;no;nonsense;;", "met_sla is no number: no; registered_at is no time: nonsense")
    ]
    assert told[0].file.endswith("cases.csv")


def test_each_stamp_is_read_once(spark, source):
    plan = intake.take_in_cases(spark, source).judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 3


def test_one_delivery_is_refused(spark, source, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(deliveries, "deliver", lambda *_: made.append(1) or source)
    row = deliveries.refused(spark, str(tmp_path)).first()
    assert (row.outcome, row.n_rows, row.first_id, row.last_id, row.n_versions) == ("refused", 2, 1, 3, 1)
    assert len(made) == 1


def test_a_refused_delivery_leaves_its_rejects(spark, source, tmp_path):
    target = str(tmp_path / "store")
    with pytest.raises(writers.TooManyRejects, match="1 rows .* see (.*)") as error:
        writers.refresh_snapshot(spark, source, target, reject_limit=0)
    folder = str(error.value).rpartition("see ")[2]
    assert spark.read.schema(intake.REJECTS_LAYOUT).parquet(folder).count() == 1
    assert store.find(spark, target) is None


@pytest.fixture
def tables(spark, tmp_path):
    """Star tables with missing values, keys that come twice, and keys that meet nothing."""
    day, pick = datetime(1998, 6, 1), Random(4).choice
    rows = {
        "region": [(0, "ASIA"), (1, None)],
        "nation": [(0, "N_0", 0), (7, "N_7", 1), (8, None, 0), (8, "twice", 0), (9, "lost", 5)],
        "customer": [(1, "c", 0, 1.0, "M"), (2, None, 7, None, None), (2, "twice", 8, 1.0, "F"), (3, "c", None, 1.0, "M")],
        "supplier": [(1, "s_1", 0, 1.0), (2, None, 7, 1.0), (2, "twice", 8, None), (3, "s_3", 9, 1.0)],
        "part": [(1, "a b", "B1", "T", 10, 1.0), (2, "c d", "B2", None, 45, 1.0), (2, None, None, "T", 21, 1.0), (-3, "e f", "B", "T", None, 1.0)],
        "orders": [
            (i, c, status, 1.0, day + timedelta(days=i) if i % 5 else None, priority)
            for i, (c, status, priority) in enumerate(product((1, 2, 3, None), ("O", "P", "F", None), ("1-URGENT", "5-LOW", None)))
        ] + [(None, 1, "O", 1.0, day, "5-LOW"), (7, 1, "F", 1.0, day, "2-HIGH")],
        "lineitem": [
            (pick(range(-2, 52)), pick((1, 2, 2, -3, 4, None)), pick((1, 2, 2, 3, 4)), pick(range(-1, 8)), pick((None, 1.0, 30.0, 2.5)), 1.0,
             pick((None, 0.0, 0.01, 0.04, 0.05, 0.1)), pick((None, 0.0, 0.06, 0.07, 0.08)), pick(("A", "N", "R", None)), pick(("O", "F", None)), day)
            for i in range(600)
        ] + [(1, 1, 1, None, 1.0, 1.0, 0.01, 0.06, "A", "O", day), (None, 1, 1, 1, 1.0, 1.0, 0.01, 0.06, "A", "O", day)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, star_tables.LAYOUTS[name]).write.parquet(f"{tmp_path}/tables/{name}.parquet")
    return f"{tmp_path}/tables"


@pytest.fixture
def all_moved(spark):
    """No table is small enough to be sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_narrow_rows_are_the_same_cases(spark, tables):
    whole = Counter(tuple(r) for r in star_tables.cases(spark, tables).select(*schema.CASE_COLUMNS).collect())
    assert Counter(tuple(r) for r in star_tables.cases_by_narrow_rows(spark, tables).collect()) == whole
    odd = "case_id % 2 = 1"
    kept = Counter()
    for chosen, share in product((odd, f"NOT ({odd})"), range(3)):
        found = star_tables.cases_by_narrow_rows(spark, tables, chosen, share, 3)
        assert not found.filter(f"NOT ({chosen})").count()
        part = Counter(tuple(r) for r in found.collect())
        assert part
        kept += part
    assert kept == Counter({r: n for r, n in whole.items() if r[0] is not None}) and None in {r[0] for r in whole}


def test_lines_are_moved_without_texts(spark, tables, all_moved):
    plan = star_tables.cases_by_narrow_rows(spark, tables)._jdf.queryExecution().executedPlan().toString()
    moved = {}
    for line in plan.splitlines():
        if found := re.search(r"Exchange hashpartitioning\((\w+)#", line):
            moved[found[1]] = True
    assert {"l_orderkey", "l_suppkey", "l_partkey"} <= set(moved)
    # What is moved by part, the last of the three, is made of the columns below its Exchange.
    below = plan[plan.index("hashpartitioning(l_partkey") :].splitlines()[1]
    assert "s_name" in below and not re.search("p_name|r_name|n_name|l_returnflag|l_discount|o_orderpriority", below)


def test_a_delivery_leaves_nothing_but_its_files(spark, tables, tmp_path, monkeypatch, all_moved):
    base = tmp_path / "shared"
    monkeypatch.setattr(deliveries, "_folder", lambda _: f"{base}/{uuid.uuid4().hex}")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = disk.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(deliveries._CLEANUP, None)
    path = deliveries.deliver(spark, tables)
    assert [str(p) for p in base.iterdir()] == [path]
    assert shuffled() <= before and spark.conf.get(deliveries._CLEANUP, None) == setting


def test_the_report_leaves_nothing_but_the_store(spark, tables, tmp_path, monkeypatch):
    base = tmp_path / "shared"
    monkeypatch.setattr(deliveries, "_folder", lambda _: f"{base}/{uuid.uuid4().hex}")
    rows = deliveries.reports(spark, tables).collect()
    (left,) = base.iterdir()
    assert [p.name for p in left.iterdir()] == ["_store"] and rows
    assert all(p.name.endswith(".zstd.parquet") for p in (left / "_store" / "versions").rglob("part-*.parquet"))
    good = star_tables.cases(spark, tables).filter(f"case_id IS NOT NULL AND NOT {deliveries.BAD_STAMP} AND NOT {deliveries.BAD_NUMBER}")
    assert sum(r.total + r.solved for r in rows) == good.count()
