"""Column helpers. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight.functions import fixed_values as fv


def category_levels(path: Column, levels: int = 4) -> list[Column]:
    """Split ``a.b.c.d`` at the dots; missing levels are NULL, further ones are dropped."""
    parts = F.split(path, "[.]")
    return [F.get(parts, F.lit(i)) for i in range(levels)]


def fold_accents(text: Column) -> Column:
    """Replace accented lower-case letters and ``?`` by plain characters."""
    return F.translate(text, fv.ACCENTS_FROM, fv.ACCENTS_TO)


def blank_to(text: Column, label: str) -> Column:
    """Show a label where the text is blank; NULL stays NULL."""
    return F.when(text == "", F.lit(label)).otherwise(text)


def decimal_comma(text: Column) -> Column:
    """Read a number written with a decimal comma; NULL where it is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_stamp(text: Column, pattern: str = fv.STAMP_FORMAT) -> Column:
    """Read day/month/year time text as a zone-free timestamp; blank or bad text is NULL."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def strict_stamp(text: Column, pattern: str = fv.STAMP_FORMAT) -> Column:
    """The same, but text that is neither blank nor a time is an error."""
    told = F.concat(F.lit("not a time: "), text)
    parsed = F.coalesce(parse_stamp(text, pattern), F.raise_error(told).cast("timestamp_ntz"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", parsed)


def hour_start(stamp: Column) -> Column:
    """Cut to the hour without leaving the zone-free type (``date_trunc`` would)."""
    return F.to_date(stamp).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(stamp), F.lit(0), F.lit(0)
    )


def hour_number(stamp: Column) -> Column:
    """Hours since the epoch: a cheap grouping key for hours, with no interval arithmetic."""
    return F.unix_date(F.to_date(stamp)) * 24 + F.hour(stamp)


def hour_of_number(number: Column) -> Column:
    """The stamp of an hour number; meant for grouped rows."""
    hour = F.pmod(number, F.lit(24))
    day = F.date_from_unix_date(((number - hour) / 24).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0))


def day_text(stamp: Column) -> Column:
    return F.date_format(stamp, fv.DAY_FORMAT)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def is_weekday(stamp: Column) -> Column:
    return F.weekday(F.to_date(stamp)) < 5


def ratio(part: Column, whole: Column) -> Column:
    """Division as double; NULL on a zero whole (ANSI mode would raise)."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def percent_text(value: Column) -> Column:
    """``0.9398`` as ``93.98%``, without a trailing ``.0``."""
    number = half_even(value * 100, 2).cast("string")
    return F.concat(F.regexp_replace(number, r"\.0$", ""), F.lit("%"))


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep the value inside a display range; NULL stays NULL."""
    return F.when(
        value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    )


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def not_in(value: Column, members) -> Column:
    """Negated membership that keeps NULL, unlike SQL ``NOT IN``."""
    return value.isNull() | ~value.isin(list(members))
