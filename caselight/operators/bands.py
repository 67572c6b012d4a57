"""Traffic-light bands. A value that no rule covers, or that is missing, gets ``none``.

Each function takes column names and gives one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv


def _band(red: str, orange: str | None, green: str) -> Column:
    # Tested in this order; conditions on NULL fall through.
    middle = f" WHEN {orange} THEN 'orange'" if orange else ""
    return F.expr(f"CASE WHEN {red} THEN 'red'{middle} WHEN {green} THEN 'green' ELSE 'none' END")


def target_band(value: str, target: str, tolerance: str) -> Column:
    """Compliance and effectiveness; exactly target - tolerance has no band."""
    low = f"({target} - {tolerance})"
    return _band(
        f"{value} < {low}", f"{value} > {low} AND {value} <= {target}", f"{value} > {target}"
    )


def speed_band(value: str) -> Column:
    """Speed; exactly 0.4 and exactly 1 have no band."""
    floor, low, ceiling = (f"{v}D" for v in (fv.SPEED_FLOOR, fv.SPEED_LOW, fv.SPEED_CEILING))
    return _band(
        f"{value} < {floor} OR {value} > {ceiling}",
        f"{value} > {floor} AND {value} <= {low}",
        f"{value} > {low} AND {value} < {ceiling}",
    )


def quota_band(percent: str) -> Column:
    """Solved quota; red is tested first, so orange cannot occur, and 95 has no band."""
    full, margin = fv.QUOTA_FULL, fv.QUOTA_MARGIN
    return _band(
        f"{percent} + {margin} > {full}",
        f"{percent} > {full - margin} AND {percent} < {full + margin}",
        f"{percent} < {full - margin}",
    )


def capacity_band(due: str, p0: str) -> Column:
    """Cases to close against capacity; exactly 90 % of it has no band."""
    low = f"({p0} - {p0} * {fv.CAPACITY_MARGIN}D)"
    return _band(f"{due} > {p0}", f"{due} > {low}", f"{due} < {low}")


def missed_band(missed: str, limit: str) -> Column:
    return _band(f"{missed} >= {limit}", None, f"{missed} < {limit}")
