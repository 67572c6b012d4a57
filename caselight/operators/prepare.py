"""Base preparation: derived flags, exclusions, scopes and row predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv
from caselight.functions.columns import month_start, not_in
from caselight.functions.contract import absent, mark_absent

FINISHED = ("CLOSED", "SOLVED")
DENIED = "DENIED"


def with_missed(df: DataFrame) -> DataFrame:
    """``missed`` = 1 - ``met_sla``; not delivered if that is not."""
    with_flag = df.withColumn("missed", 1 - F.col("met_sla"))
    return mark_absent(with_flag, ["missed"]) if "met_sla" in absent(df) else with_flag


def exclude_cases(df: DataFrame, bad_ids=()) -> DataFrame:
    """Drop listed cases; rows without an id stay.

    A Python list becomes a filter the scan can use. A DataFrame of any size is
    anti-joined, without a hint.
    """
    if isinstance(bad_ids, DataFrame):
        return df.join(bad_ids.select("case_id"), "case_id", "left_anti")
    return df.filter(not_in(F.col("case_id"), bad_ids)) if bad_ids else df


def exclude_units(df: DataFrame, groups=(), subgroups=()) -> DataFrame:
    """Drop whole groups and subgroups; rows without a unit stay."""
    if groups:
        df = df.filter(not_in(F.col("grp"), groups))
    if subgroups:
        df = df.filter(not_in(F.col("subgrp"), subgroups))
    return df


def scope(
    df: DataFrame, service_type: str | None = None, case_type: str | None = None
) -> DataFrame:
    """Keep one service type and/or one case type; None keeps all."""
    if service_type is not None:
        df = df.filter(F.col("service_type") == service_type)
    if case_type is not None:
        df = df.filter(F.col("case_type") == case_type)
    return df


def by_area(df: DataFrame, area: str | None = None) -> DataFrame:
    return df if area is None else df.filter(F.col("area") == area)


def open_condition(rule: str = "unsolved") -> Column:
    """The three meanings of an open case.

    ``unsolved``: no solve time. ``state``: neither closed nor solved.
    ``actionable``: the same, and not denied. A missing state counts as open.
    """
    if rule == "unsolved":
        return F.col("solved_at").isNull()
    if rule == "state":
        return not_in(F.col("state"), FINISHED)
    if rule == "actionable":
        return not_in(F.col("state"), (*FINISHED, DENIED))
    raise ValueError(f"unknown rule: {rule}")


def open_cases(df: DataFrame, rule: str = "unsolved") -> DataFrame:
    return df.filter(open_condition(rule))


def solved_cases(df: DataFrame) -> DataFrame:
    return df.filter(F.col("solved_at").isNotNull())


def included(df: DataFrame, label: str = "INCLUDED") -> DataFrame:
    """Rows that count in the indicators."""
    return df.filter(F.col("inclusion") == label)


def missed_cases(df: DataFrame) -> DataFrame:
    return df.filter(F.col("missed") == 1)


def month_window(df: DataFrame, ts: str, as_of: date) -> DataFrame:
    """Rows from the first of the month of ``as_of`` to the first of the month 30 days on."""
    day = F.lit(as_of)
    low = month_start(day).cast("timestamp_ntz")
    high = month_start(F.date_add(day, fv.CHART_WINDOW_DAYS)).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= low) & (F.col(ts) <= high))


def first_appearance(
    df: DataFrame, col: str, order_col: str, stretches: int = 256
) -> DataFrame:
    """Number the distinct values 1, 2, ... by first appearance, ties by value.

    The values never meet in one task, whatever their stamps are: some of them, chosen by a hash,
    cut the order of (first seen, value) into stretches; values are ranked inside their stretch
    and moved up by the number of values in the stretches before it. Cuts follow from the values
    alone, so a task that is run again finds the same ones. Their number is fixed by
    ``stretches``; only cuts and stretches are ordered in one place.
    """
    place = F.struct("first_seen", "value")
    firsts = df.groupBy(F.col(col).alias("value")).agg(F.min(order_col).alias("first_seen"))
    # Every fourth of four times as many chosen values: the stretches come out more even.
    chosen = firsts.orderBy(F.xxhash64("value"), "value").limit(4 * stretches)
    cuts = chosen.agg(F.array_sort(F.collect_list(place)).alias("cuts"))
    cuts = cuts.select(F.filter("cuts", lambda _, i: i % 4 == 0).alias("cuts"))
    before = F.size(F.filter("cuts", lambda cut: cut <= place))
    placed = firsts.withColumn("cuts", cuts.scalar()).select("*", before.alias("stretch")).drop("cuts")
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("stretch")
        .agg(F.count(F.lit(1)).alias("arrived"))
        .withColumn("shift", F.coalesce(F.sum("arrived").over(earlier), F.lit(0)))
        .select(F.col("stretch").alias("of"), "shift")
    )
    within = Window.partitionBy("stretch").orderBy("first_seen", "value")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, F.col("stretch") == F.col("of"))
        .select("value", (F.col("rank") + F.col("shift")).alias("number"))
    )


def pseudonymise(
    df: DataFrame, col: str = "specialist", order_col: str = "registered_at", prefix: str = "User"
) -> DataFrame:
    """Replace a name by ``User<k>``, k by first appearance in the given rows.

    The numbers depend on the rows, so apply it after every scope. A frequent name skews
    only the join side that adaptive execution can split.
    """
    names = first_appearance(df, col, order_col).select(
        F.col("value").alias("_name"),
        F.concat(F.lit(prefix), F.col("number").cast("string")).alias("_pseudonym"),
    )
    shown = [F.col("_pseudonym").alias(c) if c == col else F.col(c) for c in df.columns]
    return df.join(names, F.col(col).eqNullSafe(F.col("_name"))).select(*shown)


def pseudonymise_stable(df: DataFrame, salt: str, col: str = "specialist") -> DataFrame:
    """Salted digest instead of a number: equal across scopes and free of shuffles."""
    return df.withColumn(col, F.sha2(F.concat(F.lit(salt), F.col(col)), 256))
