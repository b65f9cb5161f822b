"""Dates in texts and what they add to a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.columns import WS, text

# How dates are written, and the figures of the boost.
WRITTEN = [r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})", rf"(20\d{{2}})年{WS}*(\d{{1,2}})月{WS}*(\d{{1,2}})日?"]
BASE_DATE, SPAN_DAYS, TOP = "2020-01-01", 2500, 0.05
CUTOFF_DAYS, CUTOFF_TOP, LATE = 3650, 0.055, -0.03


def extract_dates(x: Column | str) -> Column:
    """All valid dates of a text, pattern by pattern, in order."""
    found = []
    for pattern in WRITTEN:
        part = lambda i, p=pattern: F.regexp_extract_all(text(x), F.lit(p), F.lit(i))
        spelled = F.zip_with(F.zip_with(part(1), part(2), lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))), part(3), lambda ym, d: F.concat(ym, F.lit("-"), F.lpad(d, 2, "0")))
        found.append(F.filter(F.transform(spelled, lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull()))
    return F.concat(*found)


def cutoff(query: Column | str) -> Column:
    """The latest date of a question; null without one."""
    return F.array_max(extract_dates(query))


def date_boost(dates: Column, until: Column) -> Column:
    """A score for how new the newest date is; with a cutoff, how close before it."""
    fit = F.array_max(F.filter(dates, lambda d: d <= until))
    days = F.greatest(F.date_diff(until, fit), F.lit(0))
    near = F.greatest(F.lit(0.0), CUTOFF_TOP - F.least(days, F.lit(CUTOFF_DAYS)) / CUTOFF_DAYS * CUTOFF_TOP)
    age = F.greatest(F.date_diff(F.array_max(dates), F.lit(BASE_DATE).cast("date")), F.lit(0))
    newest = F.least(age / SPAN_DAYS * TOP, F.lit(TOP))
    return F.when(F.size(dates) == 0, 0.0).when(until.isNull(), newest).when(fit.isNull(), LATE).otherwise(near)
