"""Typed literals, and text spans counted in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, and the units that a number's suffix stands for where it isn't the unit itself.
SIGNS = {"¥": "CNY", "$": "USD", "€": "EUR"}
SUFFIXES = {"元": "CNY", "美元": "USD", "欧元": "EUR"}
AMOUNT = r"(?i)^(?:([¥$€])\s*)?([+-]?\d+(?:\.\d+)?)\s*(CNY|USD|EUR|亿元|万元|亿人|万人|亿|万|元|美元|欧元|人)?$"
DATE = r"^(\d{4})[-年](\d{1,2})[-月](\d{1,2})日?$"
TRUE, FALSE = ("true", "是"), ("false", "否")


def boolean(c: Column | str) -> Column:
    """True or false by word; null for anything else."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def calendar_date(c: Column | str) -> Column:
    """yyyy-mm-dd of a whole date that the calendar has, from year 100 on; null otherwise."""
    year, month, day = (F.regexp_extract(F.trim(c), DATE, g) for g in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year >= "0100") & iso.try_cast("date").isNotNull(), iso)


def amount(c: Column | str, unit: Column, needs_unit: Column) -> Column:
    """(value, unit) of a number: a given unit goes before the sign's, the sign's before the suffix's. Null if it is no
    finite number, if a needed unit is missing, or if the sign contradicts the unit."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit(""))
    sign, digits, suffix = (F.nullif(F.regexp_extract(plain, AMOUNT, g), F.lit("")) for g in (1, 2, 3))
    of_sign = F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv))[sign]
    of_suffix = F.coalesce(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[suffix], F.upper(suffix))
    found, value = F.coalesce(F.upper(unit), of_sign, of_suffix), digits.try_cast("double")
    refused = (needs_unit & found.isNull()) | F.coalesce(of_sign != found, F.lit(False)) | (F.abs(value) == float("inf"))
    return F.when(value.isNotNull() & ~refused, F.struct(value.alias("value"), found.alias("unit")))


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_offset(c: Column | str, points: Column) -> Column:
    """The place in UTF-16 units of the place that lies `points` code points into the text."""
    return utf16_length(F.substring(c, F.lit(1), points))


def utf16_slice(c: Column | str, start: Column, end: Column) -> Column:
    """The text between two UTF-16 places; null if they don't lie in the text in this order, or if one splits a pair."""
    units = F.encode(c, "UTF-16BE")

    def whole(at: Column) -> Column:
        return ~F.hex(F.substring(units, at * 2 + 1, F.lit(1))).rlike("^D[C-F]")

    inside = (start >= 0) & (start < end) & (end <= utf16_length(c)) & whole(start) & whole(end)
    return F.when(inside, F.decode(F.substring(units, start * 2 + 1, (end - start) * 2), "UTF-16BE"))
