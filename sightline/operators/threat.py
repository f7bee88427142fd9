"""Species statistics, threat levels, impact and lists of single sightings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geo import round_half_up
from sightline.functions.risk import recommendation_text, removal_trend, risk_band, threat_color, threat_urgency, trend_text
from sightline.functions.text import percent_text, to_fixed
from sightline.functions.times import is_today, is_yesterday
from sightline.operators.predicates import (
    has_location, in_bbox, is_invasive_loose, is_invasive_named, is_invasive_truthy, not_removed,
)
from sightline.operators.spatial import active, newest_first, species_diameter, species_or

RISK_BANDS = ["high", "medium", "low", "unknown"]


def _newest_value(column: str | Column) -> Column:
    """Value of the newest row that has one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.max_by(c, F.when(c.isNotNull(), newest_first()))


def species_stats(s: DataFrame) -> DataFrame:
    """Per species of active sightings: counts, confidence, dates, centroid, diameter, newest facts.

    The scientific name is that of the newest sighting that has one, if the rows have such a column at all.
    """
    rows = active(s)
    name = _newest_value(F.nullif("scientific_name", F.lit(""))) if "scientific_name" in s.columns else F.lit(None).cast("string")
    at = has_location(F.col("lng"), F.col("lat"))
    stats = rows.groupBy(species_or("Unknown Species").alias("species")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count(F.lit(1)) * 100).alias("avg_confidence"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.count_if(at).alias("locations"),
        F.avg(F.when(at, F.col("lat"))).alias("avg_lat"), F.avg(F.when(at, F.col("lng"))).alias("avg_lng"),
        _newest_value("image_path").alias("image_path"),
        F.coalesce(_newest_value("risk_level"), F.lit("Unknown")).alias("risk_level"),
        F.coalesce(name, F.lit("")).alias("scientific_name"),
    )
    return (
        stats.join(species_diameter(s), "species", "left")
        .withColumn("diameter_km", F.coalesce("diameter_km", F.lit(0.0)))
        .orderBy(F.desc("n"), "species")
    )


def invasive_risk(s: DataFrame, min_n: int = 3) -> DataFrame:
    """High-risk species: named, with ``min_n`` active sightings or any severe one."""
    named = active(s).where(is_invasive_named(F.col("predicted_species")))
    per = named.groupBy("predicted_species").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(F.lower("risk_level").contains("severe"), F.lit(False))).alias("severe"),
    )
    return per.agg(
        F.count_if((F.col("n") >= min_n) | F.col("severe")).alias("high_risk_species"),
        F.count(F.lit(1)).alias("total_species"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_sightings"),
    )


def risk_breakdown(s: DataFrame) -> DataFrame:
    counts = s.groupBy(risk_band(F.col("risk_level")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = s.sparkSession.createDataFrame(list(enumerate(RISK_BANDS)), "band_no int, band string")
    return bands.join(counts, "band", "left").select("band_no", "band", F.coalesce("n", F.lit(0)).alias("n")).orderBy("band_no")


def invasive_daily(s: DataFrame, as_of: Column) -> DataFrame:
    """One row for the day of ``as_of``: new detections, removals, threat level, texts and actions."""
    sp, ts, gone = F.col("predicted_species"), F.col("created_at"), F.col("removed_at")
    standing = is_invasive_truthy(sp) & not_removed(F.col("is_removed"))
    sums = s.agg(
        F.count_if(standing & is_today(ts, as_of)).alias("new_today"),
        F.count_if(standing & is_yesterday(ts, as_of)).alias("new_yesterday"),
        F.count_if(is_today(gone, as_of)).alias("removals_today"),
        F.count_if(is_yesterday(gone, as_of)).alias("removals_yesterday"),
        F.count_if(is_invasive_loose(sp) & has_location(F.col("lng"), F.col("lat"))).alias("placed"),
        F.count_if(standing).alias("active_invasives"),
        F.count_if(~not_removed(F.col("is_removed"))).alias("removed_total"),
        F.count_if(is_invasive_truthy(sp)).alias("invasive_total"),
    )
    today, before = F.col("new_today"), F.col("new_yesterday")
    level = F.when(today >= 5, "high").when(today >= 2, "medium").otherwise("low")
    actions = F.array_compact(F.array(
        F.when(today > 0, F.concat(F.lit("Inspect "), today.cast("string"), F.lit(" new invasive detection"), F.when(today > 1, "s").otherwise(""))),
        F.when(today >= 5, "Consider emergency herbicide application"),
        F.when(today >= 5, "Alert neighboring farmers"),
        F.when(today > before, "Increase monitoring frequency"),
        F.when((today == 0) & (today <= before), "Continue regular monitoring schedule"),
    ))
    effect = F.when(F.col("invasive_total") > 0, F.floor(F.col("removed_total") / F.col("invasive_total") * 100)).otherwise(0)
    return sums.select(
        "new_today", "new_yesterday", "removals_today", "removals_yesterday", "active_invasives",
        level.alias("threat_level"),
        recommendation_text(level, today, F.col("removals_today")).alias("recommendation"),
        F.array_join(actions, "; ").alias("actions"),
        trend_text(today, before).alias("trend"),
        removal_trend(F.col("removals_today"), F.col("removals_yesterday")).alias("removal_trend"),
        F.greatest(F.floor(F.col("placed") / 5), F.lit(1)).alias("hotspot_count"),
        effect.cast("long").alias("control_effectiveness"),
    )


def environmental_impact(daily: DataFrame) -> DataFrame:
    """Impact figures from the active and new counts of :func:`invasive_daily`."""
    n, today = F.col("active_invasives"), F.col("new_today")

    # Limits and texts of the impact figures.
    def band(*texts: str) -> Column:
        out = F.when(n >= 20, texts[0]).when(n >= 10, texts[1]).when(n >= 5, texts[2]).when(n >= 1, texts[3])
        return out.otherwise(texts[4])

    trend = (
        F.when(today > 3, "Accelerating degradation").when(today > 1, "Steady environmental pressure")
        .when(today == 1, "New environmental threat detected").otherwise("No new environmental threats today")
    )
    return daily.select(
        n.alias("active_invasives"),
        band("Critical", "High", "Moderate", "Low", "Minimal").alias("severity"),
        band("Severe ecosystem disruption imminent", "Significant environmental degradation occurring",
             "Noticeable ecological impact developing", "Early-stage environmental pressure",
             "No active invasive threats detected").alias("description"),
        band("Immediate intervention required", "Urgent action needed within 48 hours", "Action recommended within 1 week",
             "Monitor and plan removal strategy", "Continue monitoring").alias("urgency"),
        trend.alias("daily_trend"),
        to_fixed(n * 0.25, 2).alias("area_ha"),
        round_half_up(n * 3.5).alias("water_l"),
        round_half_up(n * F.lit(math.pi) * 4.0).alias("soil_m2"),
        round_half_up(n * 1.8).alias("displaced"),
        round_half_up(n * 12.0).alias("carbon_kg"),
        F.least(n * 4.2, F.lit(100.0)).alias("risk_score"),
    )


def pair_overview(s: DataFrame) -> DataFrame:
    """Named against unknown among active sightings."""
    named = is_invasive_named(F.col("predicted_species"))
    return active(s).agg(
        F.count_if(named).alias("named"), F.count_if(~named).alias("unknown"),
        (F.count_if(named) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("named_share"),
    )


def unknown_summary(s: DataFrame) -> DataFrame:
    """Active unknown sightings: count, share of all rows, distinct labels."""
    unknown = ~is_invasive_named(F.col("predicted_species")) & not_removed(F.col("is_removed"))
    return s.agg(
        F.count_if(unknown).alias("n"),
        (F.count_if(unknown) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("share"),
        F.count_distinct(F.when(unknown, species_or("Unknown"))).alias("labels"),
    )


def unknown_newest(s: DataFrame, n: int = 10) -> DataFrame:
    rows = active(s).where(~is_invasive_named(F.col("predicted_species")))
    return rows.orderBy(F.desc("created_at"), "sighting_id").limit(n).select(
        "sighting_id", "created_at", "lng", "lat", percent_text(F.coalesce("confidence", F.lit(0.0))).alias("confidence")
    )


def split_named_unknown(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = is_invasive_named(F.col("predicted_species"))
    return s.where(named), s.where(~named)


# ---- lists ---------------------------------------------------------------------------------


def sightings_list(
    s: DataFrame, owner: int, bbox: tuple[float, float, float, float] | None = None,
    include_removed: bool = False, limit: int = 200,
) -> DataFrame:
    """Newest sightings of one owner, optionally inside a box."""
    rows = s.where(F.col("owner") == owner)
    if not include_removed:
        rows = active(rows)
    if bbox:
        rows = rows.where(in_bbox(F.col("lng"), F.col("lat"), *bbox))
    return rows.orderBy(F.desc("created_at"), "sighting_id").limit(limit)


def invasive_first(s: DataFrame) -> DataFrame:
    """All sightings, the named ones first, each part newest first."""
    return (
        s.withColumn("is_invasive", is_invasive_named(F.col("predicted_species")))
        .orderBy(F.desc("is_invasive"), F.desc("created_at"), "sighting_id")
    )


def threat_feed(s: DataFrame, n: int = 12) -> DataFrame:
    """Newest named sightings with urgency, risk and confidence texts."""
    rows = s.where(is_invasive_named(F.col("predicted_species"))).orderBy(F.desc("created_at"), "sighting_id").limit(n)
    risk = F.coalesce("risk_level", F.lit("Medium"))
    return rows.select(
        "sighting_id", "predicted_species", F.concat(F.upper(risk), F.lit(" RISK")).alias("badge"),
        threat_urgency(F.col("risk_level"), F.col("confidence")).alias("urgency"), threat_color(F.col("risk_level")).alias("color"),
        percent_text(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
    )
