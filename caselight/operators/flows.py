"""Flow edge lists (source, target, value) along a path of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv
from caselight.functions.columns import blank_to, category_levels, fold_accents
from caselight.functions.contract import require
from caselight.operators.prepare import by_area, missed_cases, open_cases, scope


def _edges(
    combos: DataFrame, path: list[Column], loose: tuple[int, ...] = ()
) -> DataFrame:
    """Count the steps of a path; step i leads from ``path[i]`` to ``path[i + 1]``.

    ``combos`` holds one row per combination of the columns in the path with its count
    ``_rows``, so labels are cut and steps spread out once per combination and not once
    per case. Accents are folded later still, on the edges, which are fewest; edges that
    become equal are added up then. Steps with a missing end are dropped, except the
    ``loose`` ones. Steps stay apart even where two of them have the same labels.
    """
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step"), a.alias("source"), b.alias("target"))
            for i, (a, b) in enumerate(zip(path, path[1:]))
        ]
    )
    edges = combos.select("_rows", F.inline(steps))
    complete = F.col("source").isNotNull() & F.col("target").isNotNull()
    if loose:
        complete = complete | F.col("step").isin(list(loose))
    keys = ["step", "source", "target"]
    counted = edges.filter(complete).groupBy(*keys).agg(F.sum("_rows").alias("value"))
    return (
        counted.select(
            "step",
            fold_accents(F.col("source")).alias("source"),
            fold_accents(F.col("target")).alias("target"),
            "value",
        )
        .groupBy(*keys)
        .agg(F.sum("value").alias("value"))
    )


def _combinations(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))


def _result(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "value")


def category_flow(
    cases: DataFrame,
    case_type: str,
    missed_only: bool = False,
    tag_level_2: bool = True,
    labels: fv.Labels = fv.ENGLISH,
) -> DataFrame:
    """area -> group -> category levels 1 to 4 for one case type.

    ``tag_level_2`` puts a blank after level-2 labels, so that a label used on two levels
    does not close a cycle.
    """
    require(cases, "category_flow", *(["missed"] if missed_only else []))
    rows = scope(cases, case_type=case_type)
    if missed_only:
        rows = missed_cases(rows)
    levels = category_levels(F.col("category_path"))
    if tag_level_2:
        levels[1] = F.concat(levels[1], F.lit(" "))
    path = [F.col("area"), blank_to(F.col("grp"), labels.no_group_flow), *levels]
    return _result(_edges(_combinations(rows, "area", "grp", "category_path"), path, loose=(0,)))


def open_flow(cases: DataFrame, labels: fv.Labels = fv.ENGLISH) -> DataFrame:
    """area -> specialist -> state for open cases; blanks of the second step are labelled."""
    require(cases, "open_flow")
    names = ["area", "specialist", "state"]
    edges = _edges(
        _combinations(open_cases(cases, "state"), *names), [F.col(c) for c in names]
    )
    second = F.col("step") == 1
    source, target = F.col("source"), F.col("target")
    return edges.select(
        F.when(second, blank_to(source, labels.no_specialist_flow))
        .otherwise(source)
        .alias("source"),
        F.when(second, blank_to(target, labels.no_state_flow)).otherwise(target).alias("target"),
        "value",
    )


def ci_state_flow(cases: DataFrame, labels: fv.Labels = fv.ENGLISH) -> DataFrame:
    """ci -> state for open cases, incomplete steps included."""
    require(cases, "ci_state_flow")
    names = ["ci", "state"]
    edges = _edges(
        _combinations(open_cases(cases, "state"), *names), [F.col(c) for c in names], loose=(0,)
    )
    return edges.select(
        blank_to(F.col("source"), labels.no_ci_flow).alias("source"),
        blank_to(F.col("target"), labels.no_state_ci_flow).alias("target"),
        "value",
    )


def client_pending_flow(pending: DataFrame, area: str | None = None) -> DataFrame:
    """area -> service -> category -> specialist; categories end in a dot."""
    require(pending, "client_pending_flow")
    names = ["area", "service", "category", "specialist"]
    path = [F.col(c) for c in names]
    path[2] = F.concat(path[2], F.lit("."))
    return _result(_edges(_combinations(by_area(pending, area), *names), path, loose=(0,)))
