"""Calendar keys, seasons and recency flags. Everything is read in the session zone (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts shown for each month, and the season names in their order.
SEASONAL_FACTORS = {
    1: "Winter dormancy - Limited invasive activity",
    2: "Early germination risk in warmer areas",
    3: "Spring emergence - High vigilance needed",
    4: "Peak germination season",
    5: "Rapid growth phase - Critical control period",
    6: "Summer expansion - Maximum spread risk",
    7: "Peak biomass - Seed production begins",
    8: "Seed dispersal season",
    9: "Fall establishment window",
    10: "Final growth push before winter",
    11: "Preparation for dormancy",
    12: "Winter planning and preparation",
}
SEASONS = ["Spring", "Summer", "Fall", "Winter"]


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_start(ts: Column) -> Column:
    """Sunday that opens the week."""
    return F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)


def week_key(ts: Column) -> Column:
    return F.date_format(week_start(ts), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def period_key(ts: Column, period: str) -> Column:
    keys = {"daily": day_key, "weekly": week_key, "monthly": month_key, "yearly": year_key}
    return keys[period](ts)


def season(ts: Column, hemisphere: str = "north") -> Column:
    """Season name; ``south`` shifts by half a year."""
    quarter = F.pmod(F.floor((F.month(ts) - 3) / 3), F.lit(4))
    if hemisphere == "south":
        quarter = F.pmod(quarter + 2, F.lit(4))
    elif hemisphere != "north":
        raise ValueError("hemisphere is 'north' or 'south'")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), (quarter + 1).cast("int"))


def seasonal_factor(month: Column) -> Column:
    texts = F.array(*[F.lit(SEASONAL_FACTORS[m]) for m in range(1, 13)])
    return F.coalesce(F.try_element_at(texts, month.cast("int")), F.lit("Seasonal assessment needed"))


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def is_today(ts: Column, as_of: Column) -> Column:
    return F.coalesce(F.to_date(ts) == F.to_date(as_of), F.lit(False))


def is_yesterday(ts: Column, as_of: Column) -> Column:
    return F.coalesce(F.to_date(ts) == F.date_sub(F.to_date(as_of), 1), F.lit(False))


def since_days(ts: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(ts >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
