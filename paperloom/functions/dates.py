"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def _units(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}s "))


def age_label(date: Column, as_of: Column) -> Column:
    """``N days ago`` below 30, months of 30 days below a year, years of 365; never a singular."""
    d = F.datediff(as_of, date)
    return F.concat(F.when(d < 30, _units(d, "day")).when(d < 365, _units(F.floor(d / 30), "month")).otherwise(_units(F.floor(d / 365), "year")), F.lit("ago"))


def age_label_long(date: Column, as_of: Column) -> Column:
    """``1 years 2 months ago``: months of what the years leave; days, of the whole age modulo 30, only where both are zero."""
    d = F.datediff(as_of, date)
    years, months, days = F.floor(d / 365), F.floor((d % 365) / 30), d % 30
    larger = F.concat(F.when(years > 0, _units(years, "year")).otherwise(""), F.when(months > 0, _units(months, "month")).otherwise(""))
    return F.concat(F.when((years <= 0) & (months <= 0), _units(days, "day")).otherwise(larger), F.lit("ago"))


def next_date(last: Column, today: Column) -> Column:
    """The last date moved by whole years, at least one, until it isn't before today. 29 February becomes the 28th."""
    years = F.greatest(F.lit(1), F.year(today) - F.year(last))
    moved = F.add_months(last, years * 12)
    return F.when(moved < today, F.add_months(last, (years + 1) * 12)).otherwise(moved)


def normalise_date(published: Column, year: Column) -> Column:
    """The published date (text) if it lies in the year, else the year's first day."""
    date = F.try_to_date(published, "yyyy-MM-dd")
    return F.when(F.year(date) == year, date).otherwise(F.make_date(year, F.lit(1), F.lit(1)))


def month_year(text: Column) -> Column:
    """``Jan 2001``; the text itself if it isn't a date."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "MMM yyyy"), text)


def window_label(days: Column) -> Column:
    years, months = F.round(days / 365).cast("int"), F.round(days / 30).cast("int")
    return F.when(days >= 36500, "All time").when(days >= 365, plural(years, "year")).when(days >= 30, plural(months, "month")).otherwise(plural(days, "day"))
