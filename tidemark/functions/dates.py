"""Date expressions: month ordinals, seeded days, ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import hash_mod, hash_pick


def month_ordinal(day: Column) -> Column:
    """Months since year 0: year * 12 + month - 1."""
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def month_start(ordinal: Column) -> Column:
    return F.make_date(F.floor(ordinal / 12).cast("int"), (ordinal % 12 + 1).cast("int"), F.lit(1))


def seeded_day(seed: str | int, span: int, *keys: Column) -> Column:
    """A day of the month from 1 to ``span`` that only depends on seed and keys."""
    return hash_mod(hash_pick(seed, *keys), span) + 1


def age_at(age: Column, month_index: Column) -> Column:
    """Age after ``month_index`` months."""
    return age + F.floor(month_index / 12)


def korean_date(day: Column) -> Column:
    """Y년 M월 D일 without leading zeros."""
    return F.concat(F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일"))


def referenced_day(text: Column) -> Column:
    """The latest day from 1 to 28 that the text names as "N일"; null if none."""
    days = F.transform(F.regexp_extract_all(text, F.lit("([0-9]{1,2})일"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(days, lambda d: d.between(1, 28)))
