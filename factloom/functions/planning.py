"""Columns that read questions: dates and ranges, temporal mode, intent and budgets, clauses, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
_MONTH = r"([0-9]{4})-([0-9]{1,2})"
_YEAR = r"\b(1[89][0-9]{2}|20[0-9]{2})\b"

#: Candidate budgets and rows selected, by intent.
BUDGETS = {"external": (0, 0), "timeline": (64, 12), "enumerative": (80, 16), "temporal": (48, 6), "multi-fact": (40, 6), "specific": (24, 4)}


def _at(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null when there is no such day."""
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def explicit_range(text: Column) -> Column:
    """(low, high), half-open, of the first date in a text at day, month or year precision; null without a valid one.

    Two full dates joined by `to` or `and` are one range, its last day included."""
    pair = _DAY + r"\s*(?:to|and)\s*" + _DAY
    a, b = (_date(*(_at(text, pair, g) for g in gs)) for gs in ((1, 2, 3), (4, 5, 6)))
    day = _date(*(_at(text, _DAY, g) for g in (1, 2, 3)))
    month = _date(_at(text, _MONTH, 1), _at(text, _MONTH, 2), F.lit("01"))
    year = _date(_at(text, _YEAR, 1), F.lit("01"), F.lit("01"))
    both = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    return (
        F.when(text.rlike(pair), F.when(a.isNotNull() & b.isNotNull() & (a <= b), both(a, F.date_add(b, 1))))
        .when(text.rlike(_DAY), F.when(day.isNotNull(), both(day, F.date_add(day, 1))))
        .when(text.rlike(_MONTH), F.when(month.isNotNull(), both(month, F.add_months(month, 1))))
        .when(text.rlike(_YEAR), both(year, F.add_months(year, 12)))
    )


def relative_range(text: Column, today: Column) -> Column:
    """(low, high) of this or last year or month, and of the last N days, weeks, months (30.44 days) or years (365.25)."""
    t = F.lower(text)
    year, month = F.trunc(today, "year"), F.trunc(today, "month")
    n = _at(t, r"last ([0-9]{1,3}) (day|week|month|year)s?", 1)
    unit = _at(t, r"last ([0-9]{1,3}) (day|week|month|year)s?", 2)
    days = F.round(n.try_cast("double") * F.when(unit == "week", 7.0).when(unit == "month", 30.44).when(unit == "year", 365.25).otherwise(1.0)).cast("int")
    both = lambda low, high: F.struct(low.cast("date").alias("low"), high.cast("date").alias("high"))
    return (
        F.when(n != "", both(F.date_sub(today, days), F.date_add(today, 1)))
        .when(t.contains("last year"), both(F.add_months(year, -12), year))
        .when(t.contains("this year"), both(year, F.add_months(year, 12)))
        .when(t.contains("last month"), both(F.add_months(month, -1), month))
        .when(t.contains("this month"), both(month, F.add_months(month, 1)))
    )


def as_of_point(text: Column) -> Column:
    """Noon of the day that `as of` names, the 15th for a month, July 1 for a year."""
    rest = F.regexp_extract(text, r"(?i)as of (.*)$", 1)
    day = _date(*(_at(rest, "^" + _DAY, g) for g in (1, 2, 3)))
    month = _date(_at(rest, "^" + _MONTH, 1), _at(rest, "^" + _MONTH, 2), F.lit("15"))
    year = _date(_at(rest, "^" + _YEAR, 1), F.lit("07"), F.lit("01"))
    return F.coalesce(F.when(rest.rlike("^" + _DAY), day), F.when(rest.rlike("^" + _MONTH) & ~rest.rlike("^" + _DAY), month), F.when(rest.rlike("^" + _YEAR), year)).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")


def temporal_mode(text: Column, today: Column) -> Column:
    """range, as-of, history or current: a named time decides, else the words of past and present."""
    t = F.lower(text)
    return (
        F.when(as_of_point(text).isNotNull(), "as-of")
        .when(explicit_range(text).isNotNull() | relative_range(text, today).isNotNull(), "range")
        .when(t.rlike(r"\b(used to|previously|formerly|in the past|history)\b"), "history")
        .otherwise("current")
    )


def intent(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.rlike(r"\b(weather|news|stock price|who won)\b"), "external")
        .when(t.rlike(r"\b(timeline|over time|chronolog)"), "timeline")
        .when(t.rlike(r"\b(all|every|list|which ones)\b"), "enumerative")
        .when(t.rlike(r"\b(when|before|after|since|as of|used to)\b") | t.rlike(_YEAR), "temporal")
        .when(t.rlike(r"\b(and|both|compare)\b"), "multi-fact")
        .otherwise("specific")
    )


def budget(intent: Column, place: int = 0) -> Column:
    return F.coalesce(*(F.when(intent == k, F.lit(v[place])) for k, v in BUDGETS.items()), F.lit(BUDGETS["specific"][place]))


def clauses(text: Column, most: int = 3) -> Column:
    """Parts of a question between conjunctions and signs, the first few that say something."""
    return F.slice(F.filter(F.transform(F.split(text, r"(?i)\s+(?:and|but|then)\s+|[;?!]"), lambda c: F.trim(c)), lambda c: F.length(c) >= 3), 1, most)


def citations(answer: Column) -> Column:
    """Distinct numbers of [M#] marks, in order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[M([0-9]{1,6})\]"), 1), lambda n: n.cast("int")))
