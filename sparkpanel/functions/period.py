"""Columns on period codes and quarter-end dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), (quarter * 3).cast("int"), F.lit(1)))


def quarter_end_of(date: Column) -> Column:
    return quarter_end(F.year(date), F.quarter(date))


def add_quarters(date: Column, n) -> Column:
    """The quarter end n quarters after a quarter end."""
    return F.last_day(F.add_months(date, (n if isinstance(n, Column) else F.lit(n)) * 3))


def period_frequency(code: Column) -> Column:
    """quarterly, monthly, annual or unknown, by the code's marker KW, MM or JJ."""
    return F.when(code.contains("KW"), "quarterly").when(code.contains("MM"), "monthly").when(code.contains("JJ"), "annual").otherwise("unknown")


def period_year(code: Column) -> Column:
    return F.substring(code, 1, 4).try_cast("int")


def period_number(code: Column) -> Column:
    """Quarter or month of the code: its last two characters."""
    return F.substring(code, 7, 2).try_cast("int")


def period_to_date(code: Column) -> Column:
    """Quarter, month or year end of a period code; null if it can't be read."""
    year, n = period_year(code), period_number(code)
    ok = code.rlike("^[0-9]{4}(KW|MM|JJ)[0-9]{2}$")
    quarterly = F.when(n.between(1, 4), quarter_end(year, n))
    monthly = F.when(n.between(1, 12), F.last_day(F.make_date(year, n, F.lit(1))))
    yearly = F.make_date(year, F.lit(12), F.lit(31))
    return F.when(ok, F.when(code.contains("KW"), quarterly).when(code.contains("MM"), monthly).otherwise(yearly))


def quarter_label(date: Column) -> Column:
    return F.format_string("%d-Q%d", F.year(date), F.quarter(date))


def next_quarter_ends(date: Column, n: int) -> Column:
    """Array of the n quarter ends after a quarter end."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: add_quarters(date, k))


def quarters_since(date: Column, start: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - F.year(start) * 4 - F.quarter(start)).cast("long")


def regime_flags(date: Column, start: str, end: str) -> dict[str, Column]:
    """in_regime and after_regime as 0 or 1."""
    return {"in_regime": date.between(F.lit(start).cast("date"), F.lit(end).cast("date")).cast("int"), "after_regime": (date > F.lit(end).cast("date")).cast("int")}


def regime_ramps(date: Column, start: str, end: str, quarter_days: float = 91.3125, most: float = 12.0) -> dict[str, Column]:
    """Quarters since the regime began (0 to `most`) and since it ended (0 on)."""
    since = lambda d: F.datediff(date, F.lit(d).cast("date")) / F.lit(quarter_days)
    return {"depth": F.least(F.lit(most), F.greatest(F.lit(0.0), since(start))), "recovery": F.greatest(F.lit(0.0), since(end))}
