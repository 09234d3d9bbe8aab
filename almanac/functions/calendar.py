"""Months, seasons, dates and periods as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.scalar import strip
from almanac.session import with_row

# Month abbreviations and full names, in calendar order.
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_LONG_NAMES = [
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE",
    "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
]

# Season names in report order.
SEASONS = ["WINTER", "PRE_MONSOON", "MONSOON", "POST_MONSOON"]
UNKNOWN = "UNKNOWN"

# Years accepted as valid.
FIRST_YEAR, LAST_YEAR = 1800, 2100


@dataclass(frozen=True)
class SeasonCalendar:
    """Month numbers of each season."""

    name: str
    winter: tuple[int, ...]
    pre_monsoon: tuple[int, ...]
    monsoon: tuple[int, ...]
    post_monsoon: tuple[int, ...]

    def months(self) -> dict[str, tuple[int, ...]]:
        return dict(zip(SEASONS, (self.winter, self.pre_monsoon, self.monsoon, self.post_monsoon)))


# The two calendars in use. They differ in December.
CALENDAR_A = SeasonCalendar("A", (1, 2), (3, 4, 5), (6, 7, 8, 9), (10, 11, 12))
CALENDAR_B = SeasonCalendar("B", (12, 1, 2), (3, 4, 5), (6, 7, 8, 9), (10, 11))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def clean_month_text(month: Column) -> Column:
    """Upper-cased month text without surrounding white space."""
    return F.upper(strip(month.cast("string")))


def month_number(month: Column, strict: bool = False) -> Column:
    """Month abbreviation to 1..12; unknown names become NULL, or raise when strict."""
    names = _literal_map({name: i + 1 for i, name in enumerate(MONTH_NAMES)})
    number = F.try_element_at(names, clean_month_text(month))
    if not strict:
        return number
    message = F.concat(F.lit("unknown month: "), F.coalesce(month.cast("string"), F.lit("NULL")))
    return F.when(number.isNotNull(), number).otherwise(F.raise_error(message).cast("int"))


def normalize_month(month: Column, keep_invalid: bool = False) -> Column:
    """Short names, long names, numbers and numeric text to a month number.

    Numbers outside 1..12 become NULL unless ``keep_invalid`` is set, which
    monitors of bad months and the zero-based repair need.
    """
    names = {name: i + 1 for i, name in enumerate(MONTH_NAMES)}
    names.update({name: i + 1 for i, name in enumerate(MONTH_LONG_NAMES)})
    text = clean_month_text(month.cast("string"))
    as_number = text.try_cast("double")
    whole = F.when(as_number == F.floor(as_number), as_number.try_cast("int"))
    number = F.coalesce(F.try_element_at(_literal_map(names), text), whole)
    return number if keep_invalid else F.when(valid_month(number), number)


def month_name(month_no: Column) -> Column:
    """1..12 to the abbreviation, NULL elsewhere."""
    return F.try_element_at(_literal_map({i + 1: n for i, n in enumerate(MONTH_NAMES)}), month_no)


def fix_zero_based_months(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Shift 0..11 month codes to 1..12 when the whole column is zero based.

    The whole column decides: every value within 0..11 and 0 present. One global
    aggregate answers that and reaches the rows as a scalar subquery. Otherwise
    rows are refused (``strict``) or left as they are.
    """
    evidence = df.agg(
        F.coalesce(
            (F.min(column) == 0) & (F.max(column) <= 11) & (F.count(F.when(F.col(column).isNull(), 1)) == 0),
            F.lit(False),
        ).alias("zero_based")
    )
    flagged = with_row(df, evidence, {"_zero_based": "zero_based"})
    month = F.col(column)
    if strict:
        refused = F.raise_error(F.lit(f"{column} is not a zero-based month column")).cast("int")
        shifted = F.when(F.col("_zero_based"), month + 1).otherwise(refused)
    else:
        shifted = F.when(F.col("_zero_based"), month + 1).otherwise(month)
    return flagged.withColumn(column, shifted.cast("int")).drop("_zero_based")


def month_start(year: Column, month_no: Column, strict: bool = False) -> Column:
    """First day of the month; impossible parts give NULL, or raise when strict."""
    date = F.when(valid_year(year) & valid_month(month_no), F.make_date(year, month_no, F.lit(1)))
    if not strict:
        return date
    return F.when(date.isNotNull(), date).otherwise(F.raise_error(F.lit("invalid year or month")).cast("date"))


def month_index(year: Column, month_no: Column) -> Column:
    """Months counted from year 0, so consecutive months differ by 1."""
    return (year * 12 + month_no).cast("int")


def season(month_no: Column, calendar: SeasonCalendar, unknown: str | None = UNKNOWN, strict: bool = False) -> Column:
    """Season of a month number; other months give ``unknown`` or raise when strict."""
    label = None
    for name, months in calendar.months().items():
        condition = month_no.isin(*months)
        label = F.when(condition, name) if label is None else label.when(condition, name)
    if strict:
        return label.otherwise(F.raise_error(F.lit("month outside 1..12")))
    return label.otherwise(F.lit(unknown))


def season_ordinal(name: Column) -> Column:
    """Season name to its position in report order."""
    return F.try_element_at(_literal_map({n: i for i, n in enumerate(SEASONS)}), name)


def season_name(ordinal: Column) -> Column:
    """Position in report order to the season name."""
    return F.try_element_at(_literal_map({i: n for i, n in enumerate(SEASONS)}), ordinal)


def valid_season(name: Column) -> Column:
    return F.coalesce(name.isin(*SEASONS), F.lit(False))


def cyclic_month(month_no: Column) -> dict[str, Column]:
    """Month as a point on the unit circle."""
    angle = month_no * (2 * math.pi) / 12
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def valid_year(year: Column) -> Column:
    return F.coalesce(year.between(FIRST_YEAR, LAST_YEAR), F.lit(False))


def valid_month(month_no: Column) -> Column:
    return F.coalesce(month_no.between(1, 12), F.lit(False))


def valid_probability(p: Column) -> Column:
    return F.coalesce(p.between(0, 1) & ~F.isnan(p), F.lit(False))


def period_thirds(df: DataFrame, year: str = "year", out: str = "time_period") -> DataFrame:
    """Label rows EARLY / MIDDLE / LATE by thirds of the observed year range."""
    bounds = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    bounded = with_row(df, bounds, {"_lo": "lo", "_hi": "hi"})
    span = F.col("_hi") - F.col("_lo")
    label = (
        F.when(F.col(year) <= F.col("_lo") + span / 3, "EARLY")
        .when(F.col(year) <= F.col("_lo") + 2 * span / 3, "MIDDLE")
        .when(F.col(year).isNotNull(), "LATE")
    )
    return bounded.withColumn(out, label).drop("_lo", "_hi")


def add_months(date: Column, months: int) -> Column:
    """Calendar month arithmetic."""
    return F.add_months(date, months)
