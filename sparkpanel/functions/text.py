"""Columns on names, labels and codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def coerce_numeric(c: Column) -> Column:
    """Text to double; what is no number (a lone full stop too) is null."""
    return F.trim(c).try_cast("double")


def metric_prefix(c: Column) -> Column:
    """What stands before the first underscore that a digit follows; the whole name if there is none."""
    found = F.regexp_extract(c, "^(.+?)_[0-9]", 1)
    return F.when(found == "", c).otherwise(found)


def level_by_title(title: Column) -> Column:
    """Level of a title; the order of the tests matters."""
    return (
        F.when(title.rlike("^WP"), "size").when(title.rlike("^A-U\\s"), "total").when(title.rlike("^[A-Z]-[A-Z]\\s"), "sector")
        .when(title.rlike("^[A-Z]\\s"), "section").when(title.rlike("^[0-9]"), "subdivision").otherwise("other")
    )


def level_by_code(code: Column) -> Column:
    """division, group, class or subclass of a dotted code."""
    parts, second = F.size(F.split(code, "\\.")), F.length(F.split_part(code, F.lit("."), F.lit(2)))
    return F.when(parts == 1, "division").when(parts >= 3, "subclass").when(second == 1, "group").otherwise("class")


#: First and last division of each section. Fixed values.
SECTIONS = [("A", 1, 3), ("B", 5, 9), ("C", 10, 33), ("D", 35, 35), ("E", 36, 39), ("F", 41, 43), ("G", 45, 47), ("H", 49, 53), ("I", 55, 56), ("J", 58, 63), ("K", 64, 66), ("L", 68, 68), ("M", 69, 75), ("N", 77, 82), ("O", 84, 84), ("P", 85, 85), ("Q", 86, 88), ("R", 90, 93), ("S", 94, 96), ("T", 97, 98), ("U", 99, 99)]


def section_of_division(division: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, low, high in reversed(SECTIONS):
        out = F.when(division.between(low, high), letter).otherwise(out)
    return out


def range_letters(title: Column) -> Column:
    """Letters of a title such as "B-F Industry"."""
    low, high = F.ascii(F.regexp_extract(title, "^([A-Z])-([A-Z])\\s", 1)), F.ascii(F.regexp_extract(title, "^([A-Z])-([A-Z])\\s", 2))
    return F.when(title.rlike("^[A-Z]-[A-Z]\\s"), F.transform(F.sequence(low, high), lambda x: F.char(x)))


def family_name(model: Column) -> Column:
    """A model name without its last part, the sector."""
    return F.regexp_replace(model, "_[^_]+$", "")


def group_label(groups: Column, default: str = "discovery") -> Column:
    """A JSON list of names as "a+b"; null, unreadable or empty lists get the default."""
    names = F.from_json(groups, "array<string>")
    return F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(F.lit(default))


def feature_set_hash(columns: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(",", F.array_sort(columns))), 1, 12)


def tier(mase: Column, eps: float = 1e-9) -> Column:
    finite = mase.isNotNull() & ~F.isnan(mase) & (F.abs(mase) < float("inf"))
    return F.when(finite & (mase <= 0.90 + eps), "Good").when(finite & (mase < 1 - eps), "Medium").otherwise("Poor")


def tier_order(c: Column) -> Column:
    return F.when(c == "Good", 0).when(c == "Medium", 1).otherwise(2)


def mae_tier(mae: Column) -> Column:
    return F.when(mae < 0.20, "good").when(mae < 0.30, "acceptable").otherwise("poor")


def mapped(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[c]


def correction_parts(label: Column) -> dict[str, Column]:
    """method, before, after and winsorized of labels such as seasonal_mean|b2_a1|winsorized."""
    parts = F.split(label, "\\|")
    number = lambda k: F.nullif(F.regexp_extract(label, f"{k}([0-9]+)", 1), F.lit("")).cast("int")
    return {"method": parts[0], "before": number("\\|b"), "after": number("_a"), "winsorized": F.array_contains(parts, "winsorized")}


def normal_group_code(c: Column) -> Column:
    """1 for "1", "1.0" and 1; other text as it is; blank is null."""
    number = F.trim(c).try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    return F.coalesce(whole, F.nullif(F.trim(c), F.lit("")))


def strip_letter_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^[A-Z][\\s\\u00A0]+", "")


def json_value(c: Column) -> Column:
    """Kind of a value that was stored as text: null, boolean, integer, number or text."""
    return F.when(c.isNull() | (c == "None"), "null").when(c.isin("True", "False"), "boolean").when(c.try_cast("long").isNotNull() & ~c.contains("."), "integer").when(c.try_cast("double").isNotNull(), "number").otherwise("text")
