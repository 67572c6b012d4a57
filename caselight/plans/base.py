"""The shared base of all reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caselight.functions import fixed_values as fv
from caselight.operators import prepare


#: The exclusions of the original setting, for ``report_base(cases, **ORIGINAL_EXCLUSIONS)``.
ORIGINAL_EXCLUSIONS = {
    "bad_ids": fv.BAD_CASE_IDS,
    "groups": fv.EXCLUDED_GROUPS,
    "subgroups": fv.EXCLUDED_SUBGROUPS,
}


def report_base(
    cases: DataFrame,
    bad_ids=(),
    groups=(),
    subgroups=(),
    service_type: str | None = None,
    case_type: str | None = None,
    pseudonyms: bool = False,
) -> DataFrame:
    """Missed flag, exclusions, scope and, if asked for, pseudonyms, in this order.

    Nothing is excluded unless it is named. Pseudonyms need a second pass over the cases, so
    ask for them only where specialists are shown.

    Lazy: a job that needs several reports should store the result as a table or
    ``persist()`` it.
    """
    df = prepare.with_missed(cases)
    df = prepare.exclude_cases(df, bad_ids)
    df = prepare.exclude_units(df, groups, subgroups)
    df = prepare.scope(df, service_type, case_type)
    return prepare.pseudonymise(df) if pseudonyms else df
