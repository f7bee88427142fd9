"""Counts over calendar periods, trends, seasons and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geo import round_half_up
from sightline.functions.risk import level_of
from sightline.functions.text import to_fixed
from sightline.functions.times import (
    SEASONS, day_key, days_between, month_key, period_key, season, seasonal_factor, since_days, week_key, year_key,
)
from sightline.operators.predicates import is_invasive_named, is_invasive_truthy, not_removed
from sightline.operators.spatial import species_or
from sightline.session import cut


def period_counts(s: DataFrame) -> DataFrame:
    """Active sightings by hour, day, week, month and year in one pass: period, key, n.

    Keys are counted together as one (hour, day) table first, so the five groupings roll up a
    small table and the sightings are shuffled once, already partially counted.
    """
    ts = F.col("created_at")
    base = (
        s.where(not_removed(F.col("is_removed")))
        .groupBy(F.hour(ts).alias("h"), F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    )
    day = F.col("d").cast("timestamp")
    keys = F.array(*[
        F.struct(F.lit(p).alias("period"), k.alias("key"))
        for p, k in [
            ("hour", F.format_string("%02d", F.col("h"))), ("daily", day_key(day)), ("weekly", week_key(day)),
            ("monthly", month_key(day)), ("yearly", year_key(day)),
        ]
    ])
    return base.select("c", F.inline(keys)).groupBy("period", "key").agg(F.sum("c").alias("n"))


def time_patterns(s: DataFrame) -> DataFrame:
    """As :func:`period_counts`, with all 24 hours present."""
    counts = period_counts(s)
    hours = s.sparkSession.range(24).select(F.lit("hour").alias("period"), F.format_string("%02d", "id").alias("key"))
    filled = hours.join(counts, ["period", "key"], "left").select("period", "key", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(counts.where(F.col("period") != "hour"))


def peak_hour(s: DataFrame) -> DataFrame:
    """Busiest hour (the earliest on a tie) and the number of distinct days."""
    c = period_counts(s)
    hour = F.when(F.col("period") == "hour", F.col("key").cast("int"))
    return c.agg(
        F.coalesce(F.max_by(hour, F.when(hour.isNotNull(), F.struct(F.col("n"), -hour))), F.lit(0)).alias("peak_hour"),
        F.count_if(F.col("period") == "daily").alias("total_days"),
    )


def hourly_every_third(s: DataFrame) -> DataFrame:
    counts = time_patterns(s).where(F.col("period") == "hour").select(F.col("key").cast("int").alias("hour"), "n")
    peak = peak_hour(s).select("peak_hour").scalar()
    return counts.where(F.col("hour") % 3 == 0).select("hour", "n", (F.col("hour") == peak).alias("is_peak")).orderBy("hour")


def recent_buckets(s: DataFrame, period: str = "daily") -> DataFrame:
    """The latest 7 days, 6 weeks, 6 months or 3 years that have sightings."""
    keep = {"daily": 7, "weekly": 6, "monthly": 6, "yearly": 3}[period]
    return period_counts(s).where(F.col("period") == period).select("key", "n").orderBy(F.desc("key")).limit(keep)


def trends(s: DataFrame, as_of: Column) -> DataFrame:
    """This week against last week, and detections per day since the oldest row."""
    ts = F.col("created_at")
    week, fortnight = since_days(ts, as_of, 7), since_days(ts, as_of, 14)
    sums = s.agg(
        F.count_if(week).alias("this_week"), F.count_if(fortnight & ~week).alias("last_week"),
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"),
    )
    this, last = F.col("this_week"), F.col("last_week")
    return sums.select(
        "this_week", "last_week", ((this + last) / 2).alias("weekly_average"),
        F.when(last > 0, (this - last) / last * 100).otherwise(0.0).alias("weekly_change"),
        (F.col("n") / F.greatest(F.coalesce(days_between(F.col("oldest"), as_of), F.lit(1.0)), F.lit(1.0))).alias("detection_rate"),
    )


def seasonal_patterns(s: DataFrame, hemisphere: str = "north") -> DataFrame:
    """Active sightings per season, empty seasons kept; the later season wins a tie."""
    counted = (
        s.where(not_removed(F.col("is_removed")))
        .groupBy(season(F.col("created_at"), hemisphere).alias("season")).agg(F.count(F.lit(1)).alias("n"))
    )
    names = s.sparkSession.createDataFrame(list(enumerate(SEASONS)), "season_no int, season string")
    filled = names.join(counted, "season", "left").select("season_no", "season", F.coalesce("n", F.lit(0)).alias("n"))
    everyone = Window.partitionBy()  # four rows
    top = F.max(F.struct("n", "season_no")).over(everyone)
    return filled.select("season_no", "season", "n", (F.col("season_no") == top["season_no"]).alias("dominant"))


# ---- timelines -----------------------------------------------------------------------------


def avg_risk(n: Column, high: Column, medium: Column) -> Column:
    return F.when(high > n / 2, "High").when(medium > n / 3, "Medium").otherwise("Low")


def _newest() -> Column:
    return F.struct((-F.unix_micros("created_at")).alias("age"), "sighting_id")


_SUMS = ["n", "high", "medium", "removed", "living"]


def _per_species(rows: DataFrame, period: str) -> DataFrame:
    """Counts and the newest sighting of each period and species."""
    risk = level_of(F.col("risk_level"))
    return rows.groupBy(period_key(F.col("created_at"), period).alias("period"), species_or("Unknown").alias("species")).agg(
        F.min(_newest()).alias("newest"), F.count(F.lit(1)).alias("n"), F.count_if(risk.contains("high")).alias("high"),
        F.count_if(risk.contains("medium")).alias("medium"), F.count_if(~not_removed(F.col("is_removed"))).alias("removed"),
        F.count_if(is_invasive_truthy(F.col("predicted_species")) & not_removed(F.col("is_removed"))).alias("living"),
    )


def _periods(per_species: DataFrame) -> DataFrame:
    """Sums of each period, and its number of species."""
    return per_species.groupBy("period").agg(*[F.sum(k).alias(k) for k in _SUMS], F.count(F.lit(1)).alias("n_species"))


def _latest(rows: DataFrame, period: str, n: int, k: int | None = None) -> DataFrame:
    """Sums of the latest ``n`` periods and their species, newest sighting first.

    The periods are chosen by their counts; species are gathered for these ``n`` only, and of more than ``k`` species each
    task passes on its first ``k``.
    """
    per_species = cut(_per_species(rows, period))
    chosen = cut(_periods(per_species).orderBy(F.desc("period")).limit(n))
    same = F.col("s.period").eqNullSafe(F.col("p.period"))
    named = per_species.alias("s").join(chosen.select("period").alias("p"), same, "left_semi")
    if k is not None:
        order = Window.partitionBy("period").orderBy("newest", "species")
        named = named.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    lists = named.groupBy("period").agg(F.transform(F.sort_array(F.collect_list(F.struct("newest", "species"))), lambda x: x["species"]).alias("species"))
    return chosen.alias("p").join(lists.alias("s"), same).select("p.*", "s.species").orderBy(F.desc("period"))


def _first_species(k: int) -> Column:
    return F.array_join(F.slice("species", 1, k), ", ")


def _invasive(s: DataFrame) -> DataFrame:
    return s.where(is_invasive_named(F.col("predicted_species")))


def timeline_weekly(s: DataFrame, n: int = 6) -> DataFrame:
    """Latest weeks of named species: count, species, average risk and actions."""
    count = F.col("n")
    actions = F.array_compact(F.array(
        F.when(count > 5, "Increase herbicide application"), F.when(count > 2, "Deploy monitoring equipment"),
        F.lit("Update control strategy"),
    ))
    return (
        _latest(_invasive(s), "weekly", n)
        .select("period", "n", "species", avg_risk(count, F.col("high"), F.col("medium")).alias("avg_risk"), actions.alias("actions"))
    )


def timeline_monthly(s: DataFrame, n: int = 4) -> DataFrame:
    """Latest months: count, species, severity of what is still standing, and the season text."""
    living = F.col("living")
    severity = (
        F.when(living >= 15, "Critical").when(living >= 8, "High").when(living >= 4, "Moderate").when(living >= 1, "Low").otherwise("Minimal")
    )
    return (
        _latest(_invasive(s), "monthly", n)
        .select("period", "n", "species", severity.alias("severity"),
                seasonal_factor(F.substring("period", 6, 2).cast("int")).alias("seasonal_factor"))
    )


def timeline_yearly(s: DataFrame, n: int = 3) -> DataFrame:
    """Latest years: count, species and what the removals restored."""
    gone = F.col("removed")
    text = F.concat(
        F.lit("Ecosystem recovery: "), to_fixed(gone / F.col("n") * 100, 1), F.lit("% invasive removal restored "),
        round_half_up(gone * 2.3).cast("string"), F.lit(" hectares, enabling "), round_half_up(gone * 1.8).cast("string"),
        F.lit(" native species return"),
    )
    recovery = F.when(gone == 0, "No ecosystem recovery data available - no removal activities recorded").otherwise(text)
    return (
        _latest(_invasive(s), "yearly", n)
        .select("period", "n", "species", gone.alias("removed"), recovery.alias("recovery"))
    )


def timeline_all(s: DataFrame, period: str, n: int | None = None) -> DataFrame:
    """All sightings by week, month or year with a short species text."""
    keep = n or {"weekly": 8, "monthly": 6, "yearly": 5}[period]
    if period == "yearly":
        years = _periods(_per_species(s, period)).orderBy(F.desc("period")).limit(keep)
        return years.select("period", "n", F.concat(F.col("n_species").cast("string"), F.lit(" unique species")).alias("species"))
    shown = {"weekly": 3, "monthly": 2}[period]
    return _latest(s, period, keep, shown).select("period", "n", _first_species(shown).alias("species"))


def avg_risk_by(s: DataFrame, period: str) -> DataFrame:
    return _periods(_per_species(s, period)).select("period", "n", avg_risk(F.col("n"), F.col("high"), F.col("medium")).alias("avg_risk"))


def distinct_species(s: DataFrame, period: str) -> DataFrame:
    named = s.select(period_key(F.col("created_at"), period).alias("period"), species_or("Unknown").alias("species")).distinct()
    return named.groupBy("period").agg(F.count(F.lit(1)).cast("int").alias("n_species"), F.sort_array(F.collect_list("species")).alias("species"))
