"""Appends and keyed updates of the sightings table, as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_sightings(df: DataFrame) -> DataFrame:
    """Incoming captures with their defaults: unknown species, confidence 0, position 0, pending."""
    def number(c: str) -> Column:
        v = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        return F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))
    return df.select(
        "sighting_id", "owner", "image_path", F.coalesce(F.col("from_video").cast("string") == "true", F.lit(False)).alias("from_video"),
        number("lng").alias("lng"), number("lat").alias("lat"),
        F.coalesce(F.nullif("predicted_species", F.lit("")), F.lit("Unknown species")).alias("predicted_species"),
        number("confidence").alias("confidence"), F.lit("pending").alias("llm_status"), "created_at",
    )


def _last(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last by ``order``, or else the largest, so that repeated updates change a row once."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(*rest)
    last = F.max_by(row, F.struct(order, *rest)) if order else F.max(row)
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def apply_analysis(sightings: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Set status and risk from results (sighting_id, status, risk_level); a failure keeps the risk.

    Of several results for one sighting the last by the column ``order`` counts.
    """
    columns = ["sighting_id", "status", "risk_level", *([order] if order else [])]
    r = _last(results.select(*columns), ["sighting_id"], order).select("sighting_id", F.col("status").alias("_status"), F.col("risk_level").alias("_risk"))
    done = F.col("_status") == "completed"
    return (
        sightings.join(r, "sighting_id", "left")
        .withColumn("risk_level", F.when(done, F.col("_risk")).otherwise(F.col("risk_level")))
        .withColumn("llm_status", F.coalesce("_status", "llm_status")).drop("_status", "_risk")
    )


def mark_removed(sightings: DataFrame, removals: DataFrame, as_of: Column) -> DataFrame:
    """Set the removal columns of matching (sighting_id, owner) rows; of repeated removals the last one counts."""
    r = removals.select(
        "sighting_id", "owner", F.coalesce("removed_at", as_of).alias("_at"), F.coalesce("removed_by", F.lit("user")).alias("_by"),
    )
    r = _last(r, ["sighting_id", "owner"], "_at")
    hit = F.col("_at").isNotNull()
    return (
        sightings.join(r, ["sighting_id", "owner"], "left")
        .withColumn("is_removed", hit | F.coalesce("is_removed", F.lit(False)))
        .withColumn("removed_at", F.coalesce("_at", "removed_at")).withColumn("removed_by", F.coalesce("_by", "removed_by"))
        .drop("_at", "_by")
    )


def removals_not_found(sightings: DataFrame, removals: DataFrame) -> DataFrame:
    return removals.join(sightings.select("sighting_id", "owner"), ["sighting_id", "owner"], "left_anti")


def code_session_join(registrations: DataFrame, uses: DataFrame, hours: int = 24) -> DataFrame:
    """Each use of a code with the registration in force: the latest one at most ``hours`` old.

    Both inputs have ``code`` and ``ts``. Only the last registration of each hour can matter to a
    later hour, so registrations shrink to one row per code and hour for the look-back, and the
    ordering inside an hour is done per (code, hour): a hot code is spread over its hours.
    """
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    regs = registrations.select("code", hour.alias("h"), F.col("ts").alias("reg_ts"))
    per_hour = regs.groupBy("code", "h").agg(F.max("reg_ts").alias("reg_ts"))
    carried = (
        per_hour.select("code", "reg_ts", F.explode(F.sequence(F.col("h") + 1, F.col("h") + hours)).alias("h"))
        .groupBy("code", "h").agg(F.max("reg_ts").alias("carried_ts"))
    )
    both = regs.select("code", "h", F.col("reg_ts").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("use_id")).unionByName(
        uses.select("code", hour.alias("h"), "ts", F.lit(1).alias("kind"), "use_id")
    )
    inside = Window.partitionBy("code", "h").orderBy("ts", "kind")
    own = F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(inside)
    looked = both.withColumn("own_ts", own).where(F.col("kind") == 1).join(carried, ["code", "h"], "left")
    last = F.coalesce("own_ts", "carried_ts")
    valid = F.col("ts") < last + F.make_dt_interval(F.lit(0), F.lit(hours))
    return looked.where(valid).select("use_id", "code", last.alias("registered_at"), F.col("ts").alias("used_at"))
