"""Versions of the snapshot, rejected rows, and files of several headers."""

import threading
from datetime import datetime

import pytest

from caselight import schema
from caselight.sources import intake, readers, store, writers

HEADER = "Caso;AREA;Cumplió SLA;Fecha de registro;Fecha de vencimiento;Fecha real de solución;Progreso Individual"
GOOD = "{};A;1;05/06/2016 09:08:07;06/06/2016 09:00:00;;12,5"


def _file(path, *rows, header=HEADER):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n", encoding="latin1")
    return str(path)


def _ids(df):
    return sorted(r.case_id for r in df.collect())


def test_a_failing_refresh_leaves_the_old_version(spark, tmp_path):
    target = str(tmp_path / "store")
    good = _file(tmp_path / "good.csv", GOOD.format(1), GOOD.format(2))
    first = writers.refresh_snapshot(spark, good, target)
    bad = _file(tmp_path / "bad.csv", GOOD.format(3), "4;A;1;05/06/2016 09:08:07;;31/31/2016 10:00:00;")
    with pytest.raises(Exception, match="not a time"):
        writers.refresh_snapshot(spark, bad, target)
    short = _file(tmp_path / "short.csv", GOOD.format(3), "4;A")
    with pytest.raises(Exception, match="(?i)malformed"):
        writers.refresh_snapshot(spark, short, target)
    with pytest.raises(writers.TooManyRejects, match="1 rows"):
        writers.refresh_snapshot(spark, bad, target, reject_limit=0)
    assert _ids(readers.read_snapshot(spark, target)) == [1, 2]
    assert store.find(spark, target).version == first.version
    assert store.history(spark, target).count() == 1


def test_versions(spark, tmp_path):
    target = str(tmp_path / "store")
    made = [
        writers.refresh_snapshot(spark, _file(tmp_path / f"{i}.csv", GOOD.format(i)), target, reject_limit=0)
        for i in range(4)
    ]
    # A reader that began on an older version can finish it.
    old = readers.read_snapshot(spark, target, made[1].version)
    assert _ids(readers.read_snapshot(spark, target)) == [3] and _ids(old) == [1]
    store.roll_back(spark, target, made[2].version)
    assert _ids(readers.read_snapshot(spark, target)) == [2]
    numbers = [r.number for r in store.history(spark, target).orderBy("number").collect()]
    assert numbers == [1, 2, 3, 4, 5]
    unfinished = store.new_version(target)
    spark.range(1).write.parquet(unfinished.folder)
    assert store.remove_old(spark, target, keep=2) == sorted([made[0].version, made[1].version])
    assert store.remove_old(spark, target, keep=2, unfinished_hours=-1.0) == [unfinished.version]
    assert _ids(readers.read_snapshot(spark, target)) == [2]
    assert _ids(readers.read_snapshot(spark, target, made[3].version)) == [3]
    with pytest.raises(ValueError, match="no version"):
        store.roll_back(spark, target, made[0].version)
    with pytest.raises(ValueError, match="no version"):
        readers.read_snapshot(spark, target, "none")


def test_readers_during_refreshes_see_one_whole_version(spark, tmp_path):
    target = str(tmp_path / "store")
    files = [_file(tmp_path / f"{i}.csv", *[GOOD.format(10 * i + k) for k in range(5)]) for i in range(3)]
    writers.refresh_snapshot(spark, files[0], target)
    seen, errors, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.append(tuple(_ids(readers.read_snapshot(spark, target))))
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for i in (1, 2, 0, 1):
        writers.refresh_snapshot(spark, files[i], target)
    done.set()
    reader.join()
    whole = {tuple(10 * i + k for k in range(5)) for i in range(3)}
    assert not errors and seen and set(seen) <= whole


def test_a_plain_folder_still_reads(spark, tmp_path):
    plain = str(tmp_path / "plain")
    rows = readers.read_cases(spark, _file(tmp_path / "a.csv", GOOD.format(7)))
    rows.write.parquet(plain)
    assert _ids(readers.read_snapshot(spark, plain)) == [7]
    assert store.find(spark, plain) is None and store.remove_old(spark, plain) == []
    assert writers.read_rejects(spark, plain).count() == 0


def test_rejects(spark, tmp_path):
    rows = [
        GOOD.format(1),
        "2;A;abc;05/06/2016 09:08:07;;;",  # no number
        "3;A;1;nonsense;32/01/2016 00:00:00;;",  # two bad stamps
        "4;A;1;05/06/2016 09:08:07",  # too few fields
        "5;A;1;05/06/2016 09:08:07;;;;extra",  # too many
        "99999999999999999999;A;1;05/06/2016 09:08:07;;;",  # a number that no id can hold
        ';A;;05/06/2016 09:08:07;; ;"a;b"',  # blanks are no errors
    ]
    source, target = _file(tmp_path / "cases.csv", *rows), str(tmp_path / "store")
    delivered = intake.take_in_cases(spark, source)
    assert _ids(delivered.rows.filter("case_id IS NOT NULL")) == [1] and delivered.rows.count() == 2
    told = {r.row_text.split(";")[0]: r for r in delivered.rejects.collect()}
    assert set(told) == {"2", "3", "4", "5", "99999999999999999999"}
    assert told["2"].reason == "met_sla is no number: abc" and told["2"].row_text.startswith("2;A;abc;05/06/2016")
    assert told["3"].reason == "registered_at is no time: nonsense; due_at is no time: 32/01/2016 00:00:00"
    assert told["4"].row_text == rows[3] and told["5"].row_text == rows[4]
    assert "not as many fields" in told["4"].reason == told["5"].reason
    assert all(r.file.endswith("cases.csv") for r in told.values())

    with pytest.raises(writers.TooManyRejects, match="5 rows .* 4 are allowed"):
        writers.refresh_snapshot(spark, source, target, reject_limit=4)
    assert store.find(spark, target) is None
    version = writers.refresh_snapshot(spark, source, target, reject_limit=5)
    assert (version.n_rows, version.n_rejected) == (2, 5)
    assert readers.read_snapshot(spark, target).count() == 2
    assert sorted(r.reason for r in writers.read_rejects(spark, target).collect()) == sorted(
        r.reason for r in told.values()
    )


def test_rejects_of_the_small_tables(spark, tmp_path):
    capacity = intake.take_in_capacity(spark, _file(tmp_path / "c.csv", "A;1;2,5", "B;x;1", "C;1;y", header="AREA;Dia;P0"))
    assert [tuple(r) for r in capacity.rows.collect()] == [("A", 1, 2.5)]
    assert sorted(r.reason for r in capacity.rejects.collect()) == ["day is no number: x", "p0 is no number: y"]
    header = "Area;especialista_resp;numero_de_caso;categoria;servicio"
    pending = intake.take_in_client_pending(spark, _file(tmp_path / "p.csv", "A;s;12;c;v", "A;s;one;c;v", header=header))
    assert pending.rows.count() == pending.rejects.count() == 1


def test_a_line_break_inside_quotes(spark, tmp_path):
    source = _file(tmp_path / "c.csv", '"X\nY";1;2,5', "Z;2;3,5", header="AREA;Dia;P0")
    cut = intake.take_in_capacity(spark, source)
    assert [r.row_text for r in cut.rejects.collect()] == ['"X']  # the other part has three fields
    whole = intake.take_in_capacity(spark, source, multiLine="true")
    assert sorted(r.area for r in whole.rows.collect()) == ["X\nY", "Z"] and whole.rejects.count() == 0


def test_files_of_several_headers(spark, tmp_path):
    folder = tmp_path / "in"
    _file(folder / "a.csv", "X;1;2,5", header="AREA;Dia;P0")
    _file(folder / "b.csv", "2;Y;note;3,5", "z;Y;note;1", header="Dia;AREA;Nota;P0")
    _file(folder / "c.csv", "W;3;1", header="AREA;Dia;P0")
    (folder / "empty.csv").write_text("")
    taken = intake.take_in_capacity(spark, str(folder))
    assert sorted(tuple(r) for r in taken.rows.collect()) == [("W", 3, 1.0), ("X", 1, 2.5), ("Y", 2, 3.5)]
    assert [(r.row_text, r.reason) for r in taken.rejects.collect()] == [("z;Y;note;1", "day is no number: z")]
    assert taken.absent == ()

    other = tmp_path / "cases"
    _file(other / "a.csv", GOOD.format(1))
    _file(other / "b.csv", "05/06/2016 09:08:07;;A;2", header="Fecha de registro;Fecha real de solución;AREA;Caso")
    taken = intake.take_in_cases(spark, str(other))
    rows = {r.case_id: r for r in taken.rows.collect()}
    assert rows[2].registered_at == datetime(2016, 6, 5, 9, 8, 7) and rows[1].met_sla == 1
    assert "met_sla" in taken.absent and "area" not in taken.absent
    assert taken.rows.dtypes == spark.createDataFrame([], schema.CASES).dtypes


def test_headers_that_cannot_be_bound(spark, tmp_path):
    with pytest.raises(ValueError, match="b.csv lacks the columns .*p0"):
        _file(tmp_path / "in" / "a.csv", "X;1;2", header="AREA;Dia;P0")
        _file(tmp_path / "in" / "b.csv", "X;1;2", header="AREA;Dia;P1")
        intake.take_in_capacity(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="more than one column for .*area"):
        intake.take_in_capacity(spark, _file(tmp_path / "d.csv", "X;Y;1;2", header="AREA;AREA;Dia;P0"))
    with pytest.raises(FileNotFoundError):
        intake.take_in_capacity(spark, str(tmp_path / "nowhere"))
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        intake.take_in_capacity(spark, str(tmp_path / "none.csv"))


def test_packed_files_and_other_encodings(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "c.csv.gz", "wt", encoding="utf-8") as out:
        out.write("﻿AREA\tDia\tP0\nGestión\t1\t2,5\n")
    taken = intake.take_in_capacity(spark, str(tmp_path / "c.csv.gz"), sep="\t", encoding="UTF-8")
    assert [tuple(r) for r in taken.rows.collect()] == [("Gestión", 1, 2.5)]
