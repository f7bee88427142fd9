"""Row predicates and small derived columns. All stay inside generated code and push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.times import is_today, is_yesterday, since_days

# Words that cannot be a species epithet.
NOT_EPITHETS = [
    "and", "or", "but", "not", "nature", "reserve", "river", "highveld", "south", "north", "east", "west", "province", "weeks",
    "meters", "metres", "garden", "labels", "figure", "treatment", "where", "found", "names", "common", "methodology", "removal",
    "individual", "species", "how", "are", "described", "origin", "family", "grass", "reed", "tree", "trees", "shrub", "vine", "aquatic",
    "pods", "flowers", "flower", "leaf", "leaves", "bark", "young", "adult", "old", "long", "over", "suckering", "all",
]
# Phrases of chapter titles, which are not species.
NOT_SPECIES_PHRASES = [
    "table of", "table of content", "acknowledgements", "introduction",
    "functions of this book", "what is the problem", "nemba", "regulations",
]


def filter_cc0(license_: Column) -> Column:
    return F.coalesce(F.upper(license_).contains("CC0"), F.lit(False))


def is_invasive_named(species: Column) -> Column:
    """A named species: no spelling of Unknown anywhere."""
    return ~F.coalesce(F.nullif(species, F.lit("")), F.lit("Unknown")).contains("Unknown")


def is_invasive_truthy(species: Column) -> Column:
    return ~F.coalesce(species, F.lit("")).isin("", "Unknown", "Unknown species")


def is_invasive_loose(species: Column) -> Column:
    return ~F.coalesce(species, F.lit("")).isin("", "Unknown")


def not_removed(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def in_bbox(lng: Column, lat: Column, min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> Column:
    """Planar box, borders included."""
    return lng.between(min_lng, max_lng) & lat.between(min_lat, max_lat)


def has_location(lng: Column, lat: Column) -> Column:
    return lng.isNotNull() & lat.isNotNull()


def looks_like_binomial(name: Column) -> Column:
    """Exactly a capitalised genus and a lower-case epithet that is not a stop word."""
    parts = F.split(F.trim(name), r"\s+")
    shape = F.trim(name).rlike(r"^\p{Lu}[^\s\p{Lu}]*\p{Ll}[^\s\p{Lu}]*\s+[a-z-]{3,}$")
    return F.coalesce(shape & ~F.element_at(parts, -1).isin(NOT_EPITHETS), F.lit(False))


def looks_like_species(name: Column) -> Column:
    lowered = F.lower(name)
    bad = F.lit(False)
    for phrase in NOT_SPECIES_PHRASES:
        bad = bad | lowered.contains(phrase)
    return F.coalesce(F.trim(name).rlike(r"^\p{Lu}\S*\s+\p{Ll}") & ~bad, F.lit(False))


def valid_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^[0-9]{6}\z"), F.lit(False))


def normalise_prediction(df: DataFrame, species: str = "predicted_species", confidence: str = "confidence") -> DataFrame:
    """Default the species and confidence, and give the lookup name (underscores as spaces)."""
    sp = F.col(species)
    conf = F.expr(f"try_cast(`{confidence}` AS DOUBLE)")
    return (
        df.withColumn(species, F.when(F.coalesce(sp, F.lit("")).isin("", "undefined", "null"), "Unknown species").otherwise(sp))
        .withColumn(confidence, F.coalesce(F.when(~F.isnan(conf), conf), F.lit(0.0)))
        .withColumn("lookup_name", F.translate(F.col(species), "_", " "))
    )


def recency_flags(s: DataFrame, as_of: Column) -> DataFrame:
    ts = F.col("created_at")
    return s.withColumns({
        "is_today": is_today(ts, as_of),
        "is_yesterday": is_yesterday(ts, as_of),
        "in_week": since_days(ts, as_of, 7),
        "in_fortnight": since_days(ts, as_of, 14),
    })
