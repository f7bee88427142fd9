"""Alerts, priorities, recommendations and notifications.

Each rule reads a few global counts, so the rows are built from one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.risk import risk_is_high
from sightline.functions.times import days_between
from sightline.operators.predicates import not_removed
from sightline.operators.spatial import active, count_hotspots

FEED_LEVELS = ["info", "warning", "critical"]


def _rules(rules: list[tuple[Column, list[Column]]], names: list[str]) -> Column:
    """Array of the rows whose condition holds."""
    rows = [F.when(cond, F.struct(*[v.alias(n) for v, n in zip(values, names)])) for cond, values in rules]
    return F.array_compact(F.array(*rows))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def alert_rows() -> Column:
    """Alert rows that follow from critical_n, recent_n and hotspots."""
    # Limits and texts of the alerts.
    return _rules([
        (F.col("critical_n") > 0, [
            F.lit("critical"), F.lit("New Invasive Species Detected"),
            _text(F.col("critical_n"), " high-risk invasive species sightings in the past week. Immediate containment required."),
            F.lit("Deploy containment teams")]),
        (F.col("hotspots") > 0, [
            F.lit("warning"), F.lit("Species Concentration Detected"),
            _text(F.col("hotspots"), " hotspots identified with high species concentration. Monitor for potential spreading."),
            F.lit("Increase surveillance")]),
        (F.col("recent_n") < 5, [
            F.lit("info"), F.lit("Low Detection Activity"),
            F.lit("Detection activity below normal levels. Consider increasing monitoring efforts."),
            F.lit("Schedule additional surveys")]),
    ], ["level", "title", "description", "action"])


def risk_alerts(s: DataFrame, as_of: Column, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    """Critical, warning and info alerts of the day: level, title, description, action."""
    recent = not_removed(F.col("is_removed")) & (days_between(F.col("created_at"), as_of) < 7)
    counts = s.agg(
        F.count_if(recent & risk_is_high(F.col("risk_level"))).alias("critical_n"), F.count_if(recent).alias("recent_n")
    ).withColumn("hotspots", count_hotspots(s, cell, min_n).scalar())
    return counts.select(F.inline(alert_rows()))


def priorities(s: DataFrame, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    high = count_hotspots(s.where(risk_is_high(F.col("risk_level"))), cell, min_n).select(F.col("hotspots").alias("high_priority"))
    every = count_hotspots(s, cell, min_n).scalar()
    return high.select(
        "high_priority", F.greatest(every - F.col("high_priority"), F.lit(0)).alias("medium_priority"), F.lit(0).cast("long").alias("low_priority")
    )


def recommendations(s: DataFrame, cell: float = 0.01, min_n: int = 3) -> DataFrame:
    counts = s.agg(F.count_if(risk_is_high(F.col("risk_level"))).alias("high_n")).withColumn(
        "hotspots", count_hotspots(s, cell, min_n).scalar()
    )
    rows = _rules([
        (F.col("high_n") > 0, [
            F.lit("Immediate Invasive Species Control"),
            _text("Deploy control measures for ", F.col("high_n"),
                  " detected invasive species. Focus on early detection and rapid response protocols."),
            F.lit("High"), F.lit("Critical")]),
        (F.col("hotspots") > 0, [
            F.lit("Enhanced Monitoring in Hotspots"),
            _text("Increase surveillance frequency in ", F.col("hotspots"),
                  " identified hotspot areas to track species spread patterns."),
            F.lit("Medium"), F.lit("High")]),
        (F.lit(True), [
            F.lit("Community Engagement Program"),
            F.lit("Expand citizen science participation to increase detection coverage and early warning capabilities."),
            F.lit("Medium"), F.lit("Medium")]),
    ], ["title", "description", "priority", "impact"])
    return counts.select(F.inline(rows))


def _active_notifications(notifications: DataFrame) -> DataFrame:
    return notifications.where(~F.coalesce("dismissed", F.lit(False)))


def alerts_new(alerts: DataFrame, notifications: DataFrame) -> DataFrame:
    """Alerts with no equal active notification."""
    known = _active_notifications(notifications).select("title", "description").distinct()
    return alerts.join(known, ["title", "description"], "left_anti")


def once_per_day(alerts: DataFrame, notifications: DataFrame, by: str = "title") -> DataFrame:
    """Alerts whose ``by`` has no active notification of the same day; both have ``raised_at``."""
    days = _active_notifications(notifications).select(by, F.to_date("raised_at").alias("_day")).distinct()
    return alerts.withColumn("_day", F.to_date("raised_at")).join(days, [by, "_day"], "left_anti").drop("_day")


def alerts_open(notifications: DataFrame, completed: DataFrame) -> DataFrame:
    """Notifications that were not completed."""
    return notifications.join(completed.select("id"), "id", "left_anti")


def alert_feed(alerts: DataFrame, notifications: DataFrame, completed: DataFrame) -> DataFrame:
    """Current alerts and stored notifications, level by level, current ones first."""
    stored = alerts_new(alerts_open(_active_notifications(notifications), completed), alerts.withColumn("dismissed", F.lit(False)))
    both = alerts.select("level", "title", "description", F.lit(0).alias("stored")).unionByName(
        stored.select("level", "title", "description", F.lit(1).alias("stored"))
    )
    levels = F.array(*[F.lit(x) for x in FEED_LEVELS])
    rank = (F.array_position(levels, F.col("level")) - 1) * 2 + F.col("stored")
    return both.select(rank.alias("rank"), "level", "title", "description", "stored").orderBy("rank", "title", "description")


def notification_badges(notifications: DataFrame) -> DataFrame:
    """Active counts and the badge class, red before blue."""
    live = ~F.coalesce("dismissed", F.lit(False))
    counts = notifications.agg(
        F.count_if(live & (F.col("type") == "risk")).alias("risk"), F.count_if(live & (F.col("type") == "weather")).alias("weather")
    )
    badge = F.when(F.col("risk") > 0, "danger").when(F.col("weather") > 0, "info")
    return counts.select("risk", "weather", (F.col("risk") + F.col("weather")).alias("total"), badge.alias("badge"))
