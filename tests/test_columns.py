from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselight.functions import columns as k


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def test_category_levels(spark):
    paths = ["", "a", "a.b.", "a.b.c.d", "a.b.c.d.e", None]
    expected = [
        ("", None, None, None),
        ("a", None, None, None),
        ("a", "b", "", None),
        ("a", "b", "c", "d"),
        ("a", "b", "c", "d"),
        (None, None, None, None),
    ]
    got = values(spark, F.struct(*[c.alias(f"l{i}") for i, c in enumerate(k.category_levels(F.col("c")))]), paths)
    assert [tuple(g) for g in got] == expected


def test_text_helpers(spark):
    assert values(spark, k.fold_accents(F.col("c")), ["áéíóúñ?", "Árbol", None]) == [
        "aeioun.",
        "Árbol",
        None,
    ]
    assert values(spark, k.blank_to(F.col("c"), "none"), ["", "x", None]) == ["none", "x", None]
    assert values(spark, k.decimal_comma(F.col("c")), ["12,5", "7", "", "1,2,3", "x", None]) == [
        12.5,
        7.0,
        None,
        None,
        None,
        None,
    ]


def test_stamps(spark):
    got = values(
        spark, k.parse_stamp(F.col("c")), ["05/06/2016 09:08:07", "5/6/2016 9:08:07", "", "x", None]
    )
    assert got == [datetime(2016, 6, 5, 9, 8, 7)] * 2 + [None, None, None]
    stamps = [datetime(2016, 6, 4, 9, 59, 59), datetime(2016, 6, 6, 10), None]
    assert values(spark, k.hour_start(F.col("c")), stamps, "timestamp_ntz") == [
        datetime(2016, 6, 4, 9),
        datetime(2016, 6, 6, 10),
        None,
    ]
    old = [datetime(1969, 12, 31, 23, 59), datetime(1970, 1, 1), datetime(1970, 1, 2, 1, 30)]
    number = k.hour_number(F.col("c"))
    assert values(spark, number, [*old, None], "timestamp_ntz") == [-1, 0, 25, None]
    assert values(spark, k.hour_of_number(number), [*old, *stamps], "timestamp_ntz") == [
        t and t.replace(minute=0, second=0) for t in [*old, *stamps]
    ]
    assert values(spark, k.is_weekday(F.col("c")), stamps, "timestamp_ntz") == [False, True, None]
    assert values(spark, k.day_text(F.col("c")), stamps, "timestamp_ntz")[0] == "04-06-2016"


@pytest.mark.parametrize("zone", ["America/New_York", "America/Sao_Paulo"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    # 02:30 on this day does not exist in New York, 00:30 on the other not in Sao Paulo.
    stamps = [datetime(2016, 3, 13, 2, 30), datetime(2016, 10, 16, 0, 30)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, k.hour_start(F.col("c")), stamps, "timestamp_ntz")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [datetime(2016, 3, 13, 2), datetime(2016, 10, 16, 0)]


def test_numbers(spark):
    assert values(spark, k.half_even(F.col("c")), [0.5, 1.5, 2.5, 2.6], "double") == [0, 2, 2, 3]
    assert values(spark, k.percent_text(F.col("c")), [0.9398, 0.935, 0.94, None], "double") == [
        "93.98%",
        "93.5%",
        "94%",
        None,
    ]
    assert values(spark, k.clamp(F.col("c"), 65, 105), [1.0, 80.0, 200.0, None], "double") == [
        65.0,
        80.0,
        105.0,
        None,
    ]
    assert values(spark, k.ratio(F.col("c"), F.lit(0)), [1, None], "int") == [None, None]
    assert values(spark, k.not_in(F.col("c"), ["a"]), ["a", "b", None]) == [False, True, True]
    assert values(spark, k.zero_if_null(F.col("c")), [3, None], "int") == [3, 0]
