from datetime import date, datetime

import pytest

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.operators import kpi
from pyspark.sql import functions as F
from caselight.functions.columns import strict_stamp
from caselight.plans.base import report_base
from caselight.sources import readers, writers

HEADER = (
    "Caso;AREA;GRUPO;Especialista;Tipo de caso;Tipo de Servicio;Estado;Incluido en los Indicadores?;"
    "Cumplió SLA;Tiempo Total Solución (minutos);Cerrado en el  periodo;Progreso Individual;"
    "Fecha de registro;Fecha real de solución;Jerarquía de Categorías;Otra columna"
)
ROWS = [
    "1;Gestión del Servicio;;Ana;Incidente;Servicios Usuario Final;Cerrado;Incluido IES,IVS,IC;"
    "1;30;1;12,5;05/06/2016 09:08:07;06/06/2016 10:00:00;a.b;x",
    '2;Telecomunicaciones;"";Luis;Requerimiento;Servicios Internos;En progreso;No incluido;'
    "0;45;0;;7/6/2016 1:02:03;;\"c;d\";y",
    "x;Telecomunicaciones;G;Luis;Incidente;Otro;Denegado;No incluido;;;;abc;no date;;;z",
]


@pytest.fixture
def extract(tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n", encoding="latin1")
    return str(path)


def test_read_cases(spark, extract):
    df = readers.read_cases(spark, extract)
    assert df.dtypes == spark.createDataFrame([], schema.CASES).dtypes
    one, two, bad = df.collect()
    assert (one.case_id, one.area, one.grp, one.case_type) == (1, "Gestión del Servicio", "", "INCIDENT")
    assert (one.service_type, one.state, one.inclusion) == ("END_USER", "CLOSED", "INCLUDED")
    assert (one.met_sla, one.elapsed_minutes, one.closed_in_period) == (1, 30, 1)
    assert one.registered_at == datetime(2016, 6, 5, 9, 8, 7)
    assert one.solved_at == datetime(2016, 6, 6, 10)
    assert (one.progress_text, one.category_path) == ("12,5", "a.b")
    assert (two.grp, two.state, two.solved_at, two.category_path) == ("", "En progreso", None, "c;d")
    assert two.registered_at == datetime(2016, 6, 7, 1, 2, 3)
    # What is no number or date is NULL; columns the extract lacks are blank or NULL.
    assert (bad.case_id, bad.met_sla, bad.registered_at, bad.subgrp, bad.due_in_month) == (
        None,
        None,
        None,
        "",
        None,
    )


def test_headers_in_dotted_form(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Caso", "Tiempo.requerido.SLA..minutos.", "Otra.columna"])
    assert readers.normalise_columns(df).columns == ["case_id", "sla_minutes", "Otra.columna"]
    assert sorted(fv.CASE_HEADERS.values()) == sorted(schema.CASE_COLUMNS)


def test_small_tables(spark, tmp_path):
    capacity = tmp_path / "capacity.csv"
    capacity.write_text("AREA;Dia;P0;Nota\nGestión del Servicio;1;12,5;x\nB;2;7;\n", encoding="latin1")
    rows = [tuple(r) for r in readers.read_capacity(spark, str(capacity)).collect()]
    assert rows == [("Gestión del Servicio", 1, 12.5), ("B", 2, 7.0)]
    pending = tmp_path / "pending.csv"
    pending.write_text(
        "Area;especialista_resp;numero_de_caso;categoria;servicio\nA;s;12;c;v\nA;;13;;v\n", encoding="latin1"
    )
    rows = [tuple(r) for r in readers.read_client_pending(spark, str(pending)).collect()]
    assert rows == [("A", "s", 12, "c", "v"), ("A", "", 13, "", "v")]


def test_tab_separated(spark, tmp_path):
    path = tmp_path / "capacity.tsv"
    path.write_text("AREA\tDia\tP0\nA\t1\t2\n", encoding="utf-8")
    df = readers.read_capacity(spark, str(path), sep="\t", encoding="UTF-8")
    assert [tuple(r) for r in df.collect()] == [("A", 1, 2.0)]


def test_refresh_and_freshness(spark, extract, tmp_path):
    target = str(tmp_path / "snapshot")
    writers.refresh_snapshot(spark, extract, target)
    stored = readers.read_snapshot(spark, target)
    assert sorted(map(str, stored.collect())) == sorted(
        map(str, readers.read_cases(spark, extract).collect())
    )
    first = readers.path_freshness(spark, target).first().modified_at
    assert readers.snapshot_freshness(stored).first().modified_at == first
    writers.refresh_snapshot(spark, extract, target)
    again = readers.read_snapshot(spark, target)
    assert again.count() == 3
    assert readers.snapshot_freshness(again).first().modified_at >= first


def test_partitioned_snapshot(spark, extract, tmp_path):
    target = str(tmp_path / "snapshot")
    writers.refresh_snapshot(spark, extract, target, partition_by=["case_type"])
    stored = readers.read_snapshot(spark, target)
    assert stored.columns == list(schema.CASE_COLUMNS)
    part = stored.filter("case_type = 'REQUEST'")
    assert [r.case_id for r in part.collect()] == [2]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(case_type" in plan


def test_semicolon_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("á", 1.5, 2, None), ("", None, 3, "x;y")], "a string, b double, c int, d string"
    )
    path = str(tmp_path / "out")
    writers.write_semicolon_csv(df.coalesce(1), path)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="latin1").splitlines()
    assert text[:2] == ["a;b;c;d", "á;1,5;2;"]
    assert text[2] == '"";;3;"x;y"'


def test_export_table(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.export_table(spark.range(2).selectExpr("id", "'a,b' AS t"), path)
    back = spark.read.option("header", True).csv(path)
    assert sorted((r.id, r.t) for r in back.collect()) == [("0", "a,b"), ("1", "a,b")]


def test_from_extract_to_indicator(spark, extract):
    base = report_base(readers.read_cases(spark, extract), service_type="END_USER", pseudonyms=True)
    assert [(r.case_id, r.specialist) for r in base.collect()] == [(1, "User1")]
    assert kpi.kpi_compliance(base, ["area"]).count() == 2
    card = kpi.scorecard(
        base,
        spark.createDataFrame([("Gestión del Servicio", 1, 2.0)], schema.CAPACITY),
        date(2016, 6, 1),
        total_label="GT",
    )
    bands = {r.area: (r.ics, r.ics_band) for r in card.collect()}
    assert bands == {"Gestión del Servicio": (1.0, "green"), "GT": (1.0, "green")}


def _write(folder, *texts):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i}.csv").write_text(text, encoding="latin1")
    return str(folder)


def test_files_of_different_headers_are_an_error(spark, tmp_path):
    path = _write(tmp_path / "a", "AREA;Dia;P0\nX;1;2,5\n", "Dia;AREA;P0\n2;Y;3,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_capacity(spark, path).collect()


def test_a_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="day"):
        readers.read_capacity(spark, _write(tmp_path / "a", "AREA;Day;P0\nX;1;2,5\n"))


def test_a_line_break_inside_quotes(spark, tmp_path):
    path = _write(tmp_path / "a", 'AREA;Dia;P0\n"X\nY";1;2,5\nZ;2;3,5\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_capacity(spark, path).collect()
    rows = readers.read_capacity(spark, path, multiLine="true").collect()
    assert [(r.area, r.day, r.p0) for r in rows] == [("X\nY", 1, 2.5), ("Z", 2, 3.5)]


def test_a_time_that_is_none_is_an_error(spark, extract):
    bad = spark.sql("SELECT '31/31/2016 10:00:00' AS t UNION ALL SELECT ' ' UNION ALL SELECT NULL")
    good = bad.filter("trim(coalesce(t, '')) = ''").select(strict_stamp(F.col("t")).alias("t"))
    assert [r.t for r in good.collect()] == [None, None]
    with pytest.raises(Exception, match="not a time"):
        bad.select(strict_stamp(F.col("t"))).collect()
