"""Date expressions of daily series."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_fraction(d: Column) -> Column:
    """Day of the year over the year's days: 1/365 .. 1, leap years too."""
    return F.dayofyear(d) / F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def doy0(d: Column) -> Column:
    """0-based day of the year, 0 .. 365."""
    return F.dayofyear(d) - 1


def water_year(d: Column, first_month: int = 1) -> Column:
    """The year in which the water year that holds d ends; with month 1 the calendar year."""
    return F.year(d) + (0 if first_month == 1 else (F.month(d) >= first_month).cast("int"))


def period_of(resolution: str) -> tuple[int, str]:
    """'1d', '2w', '12m' as number and unit; only whole days of one are allowed."""
    number, unit = resolution[:-1], resolution[-1:]
    if unit not in ("d", "w", "m") or not number.isdigit() or not 1 <= len(number) <= 2 or int(number) < 1 or unit == "d" and number != "1":
        raise ValueError(f"time resolution {resolution!r}: 1d, or a number of weeks (w) or months (m)")
    return int(number), unit
