"""Risk bands, colours and the sentences built from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.geo import round_half_up
from sightline.functions.times import days_between

# Colours of the bands and of the age ramp.
COLOR_HIGH, COLOR_MEDIUM, COLOR_LOW = "#dc2626", "#d97706", "#059669"
COLOR_NEW, COLOR_OLD, COLOR_UNKNOWN = "#FFD700", "#FF4444", "#10b981"
RAMP_DAYS = 30


def risk_is_high(risk: Column) -> Column:
    return F.coalesce(F.lower(risk).rlike("high|severe"), F.lit(False))


def risk_band(risk: Column) -> Column:
    """high / medium / low / unknown, with the synonyms severe, moderate and minimal."""
    level = F.lower(F.coalesce(risk, F.lit("unknown")))
    return (
        F.when(level.rlike("high|severe"), "high")
        .when(level.rlike("medium|moderate"), "medium")
        .when(level.rlike("low|minimal"), "low")
        .otherwise("unknown")
    )


def risk_class(risk: Column) -> Column:
    return F.concat(F.lit("risk-"), risk_band(risk))


def level_of(risk: Column) -> Column:
    """Lower-case risk, Medium when there is none."""
    return F.lower(F.coalesce(F.nullif(risk, F.lit("")), F.lit("Medium")))


def threat_urgency(risk: Column, confidence: Column) -> Column:
    sure = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5)) > 0.8
    return (
        F.when(level_of(risk).contains("high"), "Immediate inspection required - High threat species")
        .when(level_of(risk).contains("medium") & sure, "Monitor closely - Confirmed invasive")
        .when(level_of(risk).contains("medium"), "Verify identification - Possible invasive")
        .otherwise("Routine monitoring - Low immediate threat")
    )


def threat_color(risk: Column) -> Column:
    return (
        F.when(level_of(risk).contains("high"), COLOR_HIGH)
        .when(level_of(risk).contains("medium"), COLOR_MEDIUM)
        .otherwise(COLOR_LOW)
    )


def age_color(created_at: Column, as_of: Column) -> Column:
    """Yellow for new, red from thirty days on, a linear ramp between."""
    ratio = days_between(created_at, as_of) / RAMP_DAYS
    green = round_half_up(215 - 147 * ratio)
    blue = F.greatest(round_half_up(68 * (1 - ratio)), F.lit(0))
    return (
        F.when(created_at.isNull() | (ratio <= 0), COLOR_NEW)
        .when(ratio >= 1, COLOR_OLD)
        .otherwise(F.format_string("rgb(255, %d, %d)", green, blue))
    )


def sighting_color(species: Column, created_at: Column, as_of: Column) -> Column:
    from sightline.operators.predicates import is_invasive_named

    return F.when(is_invasive_named(species), age_color(created_at, as_of)).otherwise(COLOR_UNKNOWN)


def _plural(n: Column) -> Column:
    return F.when(n > 1, "s").otherwise("")


def recommendation_text(level: Column, n: Column, removals: Column) -> Column:
    thanks = F.when(
        removals > 0,
        F.concat(F.lit(" Great job removing "), removals.cast("string"), F.lit(" plant"), _plural(removals), F.lit(" today!")),
    ).otherwise("")
    count = n.cast("string")
    # Texts of the recommendations and trends.
    body = (
        F.when(level == "high", F.concat(F.lit("Critical invasion detected! "), count,
                                         F.lit(" new invasive species found. Immediate intervention required.")))
        .when(level == "medium", F.concat(F.lit("Moderate threat level. "), count,
                                          F.lit(" invasive species detected. Increase monitoring and prepare control measures.")))
        .when(n > 0, F.concat(F.lit("Low threat level. "), count,
                              F.lit(" invasive species detected. Continue regular monitoring.")))
        .otherwise("No new invasive species detected today. Maintain vigilance.")
    )
    return F.concat(body, thanks)


def trend_text(today: Column, yesterday: Column) -> Column:
    return (
        F.when(today > yesterday, F.concat(F.lit("↗ +"), (today - yesterday).cast("string"), F.lit(" from yesterday")))
        .when(today < yesterday, F.concat(F.lit("↘ -"), (yesterday - today).cast("string"), F.lit(" from yesterday")))
        .otherwise("→ Same as yesterday")
    )


def removal_trend(today: Column, yesterday: Column) -> Column:
    return F.when((today == 0) & (yesterday == 0), "→ No activity").otherwise(trend_text(today, yesterday))


def spread_trend(rate: Column) -> Column:
    return (
        F.when(rate > 30, "↗ Rapid expansion").when(rate > 15, "→ Moderate spread").otherwise("↘ Slow spread")
    )


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.8, "High confidence detection")
        .when(confidence > 0.6, "Moderate confidence detection")
        .otherwise("Low confidence detection")
    )


def action_required(confidence: Column, invasive: Column) -> Column:
    return (
        F.when((confidence > 0.8) & invasive, "Immediate action recommended")
        .when(confidence > 0.8, "Monitor for changes")
        .when(confidence > 0.6, "Further verification recommended")
        .otherwise("Manual verification required")
    )
