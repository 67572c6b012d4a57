"""Pivots with subtotals, frequent combinations and count matrices."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.functions.columns import blank_to, category_levels, day_text, half_even, ratio
from caselight.functions.contract import absent, mark_absent, require
from caselight.operators.prepare import by_area, open_cases, scope

AGGREGATES = ("sum", "count", "avg", "min", "max", "count_distinct", "count_distinct_sketch")
#: 2^12 registers of a sketch: relative standard error 0.83 / sqrt(2^12) = 1.3 %, at most 2.6 KB a group.
SKETCH_BITS = 12


def pivot_input(cases: DataFrame) -> DataFrame:
    """Columns offered to the pivot: units, kinds and the four category levels."""
    levels = [
        c.alias(f"level_{i}") for i, c in enumerate(category_levels(F.col("category_path")), 1)
    ]
    offered = cases.select("*", *levels).select(*schema.PIVOT_COLUMNS)
    if "category_path" not in absent(cases):
        return offered
    return mark_absent(offered, [f"level_{i}" for i in range(1, len(levels) + 1)])


def pivot_summary(
    df: DataFrame,
    rows: list[str],
    cols: dict[str, list] | None = None,
    value: str = "missed",
    agg: str = "sum",
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """Aggregate with subtotals over ``rows``; one further column per value in ``cols``.

    ``level`` is the number of row keys summed up (0 = detail). ``cols`` names its
    values, so that no job has to look for them; several columns are combined as
    ``a_b``. The fact rows are first reduced to one row per key, and only those rows are
    expanded into subtotals.

    Distinct counts do not add up. ``count_distinct`` is exact, and expands every distinct pair of
    keys and value into the subtotals. ``count_distinct_sketch`` keeps one sketch
    per key and unites sketches up the levels: what is expanded does not grow with the number of values. It is
    within three standard errors, 3 * 0.83 / sqrt(2 ** sketch_bits), of the exact count in
    almost all groups (3.9 % at 12 bits), and exact for a few values. Values that are neither numbers, text
    nor binary are counted by their text; missing ones are not counted, in either form.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {agg}")
    cols = cols or {}
    keys = [*rows, *cols]
    require(df, "pivot_summary", *keys, value)
    reduced, merge = _reduce(df, keys, value, agg, sketch_bits)

    def merged(condition):
        return merge(lambda c: c if condition is None else F.when(condition, c))

    measures = []
    for combo in product(*cols.values()) if cols else ():
        condition = F.lit(True)
        for name, member in zip(cols, combo):
            condition = condition & (F.col(name) == member)
        measures.append(merged(condition).alias("_".join(str(m) for m in combo)))
    measures.append(merged(None).alias(value if not cols else "total"))
    level = sum(F.grouping(r).cast("int") for r in rows) if rows else F.lit(0)
    grouped = reduced.rollup(*rows) if rows else reduced.groupBy()
    return grouped.agg(*measures, level.alias("level")).select(
        *rows, "level", *_names(cols, value)
    )


def _names(cols: dict[str, list], value: str) -> list[str]:
    if not cols:
        return [value]
    return ["_".join(str(m) for m in combo) for combo in product(*cols.values())] + ["total"]


def _reduce(df: DataFrame, keys: list[str], value: str, agg: str, sketch_bits: int):
    """One row per key with partial results, and how to merge them."""
    v = F.col(value)
    if agg == "count_distinct":
        return df.select(*keys, v.alias("_v")).distinct(), lambda on: F.count_distinct(
            on(F.col("_v"))
        )
    grouped = df.groupBy(*keys)
    if agg == "count_distinct_sketch":
        direct = df.schema[value].dataType.typeName() in ("integer", "long", "string", "binary")
        sketch = F.hll_sketch_agg(v if direct else v.cast("string"), sketch_bits)
        return grouped.agg(sketch.alias("_v")), lambda on: F.coalesce(
            F.hll_sketch_estimate(F.hll_union_agg(on(F.col("_v")))), F.lit(0)
        )
    if agg in ("sum", "min", "max"):
        fn = getattr(F, agg)
        return grouped.agg(fn(v).alias("_v")), lambda on: fn(on(F.col("_v")))
    if agg == "count":
        return grouped.agg(F.count(F.lit(1)).alias("_v")), lambda on: F.sum(on(F.col("_v")))
    return (
        grouped.agg(F.sum(v).alias("_v"), F.count(v).alias("_n")),
        lambda on: ratio(F.sum(on(F.col("_v"))), F.sum(on(F.col("_n")))),
    )


def frequent_ci(
    cases: DataFrame, pct: float = fv.FREQUENT_SHARE, labels: fv.Labels = fv.ENGLISH
) -> DataFrame:
    """Combinations of incidents that occur more often than a share of all incidents."""
    require(cases, "frequent_ci")
    keys = ["area", "grp", "ci", "service"]
    counts = (
        scope(cases, case_type="INCIDENT")
        .groupBy(*keys, F.to_date("registered_at").alias("_on"))
        .agg(F.count(F.lit(1)).alias("total"))
    )
    # The subquery sums the same grouped counts, so it shares their shuffle.
    floor = counts.agg(half_even(F.sum("total") * F.lit(pct)).alias("floor")).scalar()
    return (
        counts.filter(F.col("total") > floor)
        .withColumn("day", day_text(F.col("_on")))
        .orderBy(F.desc("total"), *keys, "day")
        .select(
            "area",
            blank_to(F.col("grp"), labels.no_group).alias("grp"),
            blank_to(F.col("ci"), labels.no_ci).alias("ci"),
            "service",
            "day",
            "total",
        )
    )


def frequent_ci_tree(frequent: DataFrame) -> DataFrame:
    """The list as nested subtotals: area, ci, service, count, day.

    ``size`` is the summed count at each node.
    """
    rows = ["area", "ci", "service", "total", "day"]
    sized = frequent.groupBy(*rows).agg(F.sum("total").alias("_size"))
    level = sum(F.grouping(r).cast("int") for r in rows)
    return (
        sized.rollup(*rows)
        .agg(F.sum("_size").alias("size"), level.alias("level"))
        .select(*rows, "level", "size")
    )


def state_matrix(cases: DataFrame, area: str | None = None) -> DataFrame:
    """Actionable cases per state and specialist."""
    require(cases, "state_matrix", *([] if area is None else ["area"]))
    return (
        by_area(open_cases(cases, "actionable"), area)
        .groupBy("state", "specialist")
        .agg(F.count(F.lit(1)).alias("total"))
    )
