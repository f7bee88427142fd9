"""Live forms of the batch operators, for any streaming source with the same columns.

Each function takes streaming tables and returns one; :func:`run_to_table` drives it to a table
of changes whose latest row per key is the current state. State is bounded by a watermark, or by
the number of cells, never by the number of rows seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.functions.geo import grid_cell
from sightline.functions.risk import risk_is_high
from sightline.operators.alerts import alert_rows, alerts_new, once_per_day
from sightline.operators.predicates import has_location, not_removed
from sightline.operators.spatial import newest_first, species_or
from sightline.operators.updates import new_sightings
from sightline.session import cut


def stream_new_sightings(src: DataFrame, late: str = "1 hour") -> DataFrame:
    """Captures become pending sightings; a repeated id within the watermark is dropped."""
    return new_sightings(src.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["sighting_id"]))


#: What ends the analysis of a sighting, and the event that a completed one gives.
FINAL = ["completed", "failed"]
DONE = "analysis_done"


def _last_status(keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keeps the last result of each sighting of a bucket, by time, then status and risk; a change comes out when one moves on."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {i: (found, until) for i, *found, until in zip(*state.get)} if state.exists else {}
        changes = []
        if not state.hasTimedOut:
            last, arrived = {}, 0
            for part in rows:
                arrived = max(arrived, int(part["arrived"].max()))
                for i, *found in zip(part["sighting_id"].tolist(), part["at"].tolist(), part["status"], part["risk_level"]):
                    if i not in last or _as_order(found) > _as_order(last[i]):
                        last[i] = found
            for i, found in last.items():
                before = known[i][0] if i in known else None
                if before is not None and _as_order(found) <= _as_order(before):
                    continue  # late, or said before
                known[i] = (found, arrived + keep_ms)
                at, status, risk = found
                if before is None or before[1:] != found[1:]:
                    event = DONE if status == "completed" and (before is None or before[1] != "completed") else None
                    changes.append((i, status, risk, at, event))
        now = state.getCurrentWatermarkMs()
        held = [(i, *found, until) for i, (found, until) in known.items() if until >= now]
        if held:
            state.update(tuple(list(c) for c in zip(*held)))
            state.setTimeoutTimestamp(min(row[-1] for row in held))
        elif state.exists:
            state.remove()
        if changes:
            yield pd.DataFrame(changes, columns=["sighting_id", "status", "risk_level", "at", "event"])

    return step


def _arriving(rows: DataFrame) -> DataFrame:
    """Rows with the time of their batch, which drives the expiry of state, so that no row is late."""
    return rows.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", "1 hour").withColumn("arrived", F.unix_millis("arrived_at"))


def _as_order(result: tuple) -> tuple:
    """NULLs first."""
    return tuple((x is not None, x) for x in result)


def stream_status(results: DataFrame, keep_days: int = 30, buckets: int = 4096) -> DataFrame:
    """Changes of status (sighting_id, status, risk_level, ts, event) from results (sighting_id, status, risk_level, ts).

    The state holds the last result per sighting and forgets it ``keep_days`` after its last change. Repeated results and
    results that are older than the known one change nothing; of several in one batch the last counts. A sighting that
    becomes completed gives one ``analysis_done`` event.

    Sightings share a fixed number of ``buckets`` by a hash of their id: a call of Python and an entry of the state cost
    more than a result does. A batch rewrites the buckets it touches. A stream keeps its number of buckets for good.
    """
    rows = results.where(F.col("status").isin(*FINAL)).select(
        F.col("sighting_id").cast("long").alias("sighting_id"), F.unix_micros("ts").alias("at"), "status", "risk_level").where("sighting_id IS NOT NULL")
    # a time that is missing is before all others
    rows = rows.withColumn("at", F.coalesce("at", F.lit(-(1 << 62)))).withColumn("bucket", F.pmod(F.xxhash64("sighting_id"), F.lit(buckets)))
    changes = _arriving(rows).groupBy("bucket").applyInPandasWithState(
        _last_status(keep_days * 86_400_000), "sighting_id long, status string, risk_level string, at long, event string",
        "ids array<long>, at array<long>, status array<string>, risk_level array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("sighting_id", "status", "risk_level", F.when(F.col("at") > -(1 << 62), F.timestamp_micros("at")).alias("ts"), "event")


def _once_per_day(keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keeps the time of the alert that stands for one type and day, until it is dismissed."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, gone, arrived = None, None, 0
        for part in rows:
            arrived = max(arrived, int(part["arrived"].max()))
            for r in part.itertuples(index=False):
                if r.dismissed:
                    gone = r.at if gone is None else max(gone, r.at)
                elif first is None or (r.at, r.alert_id) < (first.at, first.alert_id):
                    first = r
        standing = state.getOption
        if first is not None and standing is None:
            yield pd.DataFrame({"type": [key[0]], "day": [key[1]], "alert_id": [first.alert_id], "at": [first.at]})
            standing = (int(first.at),)
        if standing is not None and gone is not None and gone >= standing[0]:
            state.remove()
        elif standing is not None:
            state.update(standing)
            state.setTimeoutTimestamp(arrived + keep_ms)

    return step


def stream_daily_alerts(alerts: DataFrame, keep_days: int = 2) -> DataFrame:
    """First alert of each type and day: (type, day, alert_id, raised_at) from (type, alert_id, raised_at, dismissed).

    A row with ``dismissed`` takes back the alert that stands for its type and day, so that the next one is raised again.
    The state holds one time per type and day for ``keep_days``. Rows without a type or time are left out.
    """
    rows = alerts.where(F.col("type").isNotNull() & F.col("raised_at").isNotNull()).select(
        "type", F.date_format("raised_at", "yyyy-MM-dd").alias("day"), F.col("alert_id").cast("long").alias("alert_id"),
        F.unix_micros("raised_at").alias("at"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"))
    raised = _arriving(rows).groupBy("type", "day").applyInPandasWithState(
        _once_per_day(keep_days * 86_400_000), "type string, day string, alert_id long, at long", "at long", "append", GroupStateTimeout.EventTimeTimeout)
    return raised.select("type", "day", "alert_id", F.timestamp_micros("at").alias("raised_at"))


def stream_live_counts(src: DataFrame, late: str = "1 hour") -> DataFrame:
    """Active sightings per day and species; rows later than the watermark are dropped and counted by Spark."""
    return (
        src.where(not_removed(F.col("is_removed"))).withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day").alias("w"), species_or("Unknown").alias("species"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "species", "n")
    )


def stream_code_ttl(regs: DataFrame, uses: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Uses of a code that was registered within the last ``hours``; each use comes out once."""
    r = regs.select(F.col("code").alias("reg_code"), F.col("ts").alias("reg_ts")).withWatermark("reg_ts", late)
    u = uses.select("use_id", "code", "ts").withWatermark("ts", late)
    fresh = (
        (F.col("code") == F.col("reg_code")) & (F.col("ts") >= F.col("reg_ts"))
        & (F.col("ts") < F.col("reg_ts") + F.make_dt_interval(F.lit(0), F.lit(hours)))
    )
    return u.join(r, fresh, "left_semi")


def stream_frame_sample(src: DataFrame, every: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """First frame of each owner in every interval."""
    return (
        src.withWatermark("created_at", late).groupBy(F.window("created_at", every).alias("w"), "owner")
        .agg(F.min_by("sighting_id", F.struct("created_at", "sighting_id")).alias("sighting_id"))
        .select(F.col("w.start").alias("start"), "owner", "sighting_id")
    )


def _cell_columns(tol: float) -> list[Column]:
    return [grid_cell(F.col("lat"), tol).alias("cell_lat"), grid_cell(F.col("lng"), tol).alias("cell_lng")]


def _by_day_and_cell(src: DataFrame, tol: float, late: str):
    """Groups of a day of arrival and a cell: a day's cells leave the state once the watermark has passed it.

    A row arrives with its batch, so none is late: old sightings, removals of any later day and rows without
    ``created_at`` all count.
    """
    placed = src.where(has_location(F.col("lng"), F.col("lat"))).withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", late)
    return placed.groupBy(F.window("arrived_at", "1 day").alias("w"), *_cell_columns(tol))


def stream_marker_cells(src: DataFrame, tol: float = 1e-4, late: str = "1 hour") -> DataFrame:
    """Count and newest member of each marker cell and day of arrival, re-emitted when they change."""
    found = _by_day_and_cell(src, tol, late).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("sighting_id", newest_first()).alias("newest_id"), F.max("created_at").alias("newest_at"))
    return found.select(F.col("w.start").alias("day"), "cell_lat", "cell_lng", "n", "newest_id", "newest_at")


def marker_cells(changes: DataFrame) -> DataFrame:
    """Current marker cells from the changes of ``stream_marker_cells``."""
    days = latest(changes, ["day", "cell_lat", "cell_lng"])
    return days.groupBy("cell_lat", "cell_lng").agg(F.sum("n").alias("n"), F.max_by("newest_id", F.struct("newest_at", (-F.col("newest_id")).alias("k"))).alias("newest_id"), F.max("newest_at").alias("newest_at"))


def stream_removals(src: DataFrame, tol: float = 1e-4, late: str = "1 hour") -> DataFrame:
    """Cell counts of each day of arrival after removals, from changes (sighting_id, lng, lat, created_at, delta of +1 or -1)."""
    found = _by_day_and_cell(src, tol, late).agg(F.sum("delta").alias("n"))
    return found.select(F.col("w.start").alias("day"), "cell_lat", "cell_lng", "n")


def cell_totals(changes: DataFrame) -> DataFrame:
    """Current cell counts from the changes of ``stream_removals``."""
    return latest(changes, ["day", "cell_lat", "cell_lng"]).groupBy("cell_lat", "cell_lng").agg(F.sum("n").alias("n"))


def stream_activity_sessions(src: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each owner, closed after ``gap`` of silence."""
    return (
        src.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("owner", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


# ---- sinks ---------------------------------------------------------------------------------


def run_to_table(stream: DataFrame, mode: str, out: str) -> DataFrame:
    """Run what is available and read back all changes below ``out`` with their ``batch``.

    The stream's progress and state are kept beside its output: a later run on the same folder goes
    on where this one stopped. A batch overwrites its own folder, so a retried batch leaves no double rows.
    """
    spark = stream.sparkSession

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    return _read_changes(spark, out, stream)


def _read_changes(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    schema = like.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def latest(changes: DataFrame, keys: list[str], order: str = "batch") -> DataFrame:
    """Current row of each key."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def stream_alerts(src: DataFrame, store: str, notifications: str, cell: float = 0.01, min_n: int = 3, days: int = 7) -> None:
    """Raise alerts that no active notification already states, each title once a day; a later run on the same folders goes on.

    Running totals are kept per cell and hour, and per cell alone for hours older than ``days``. A batch reads the
    totals of the one before and writes its own in the other of two places, so a retried batch finds what it needs. What
    holds after each batch is kept below ``store-current``. The reference time is the last full hour seen.
    """
    spark = src.sparkSession
    note_schema = "level string, title string, description string, action string, dismissed boolean, raised_at timestamp"
    part_schema = "cell_lat long, cell_lng long, hour timestamp, n long, high long"
    old = F.lit("1970-01-01 00:00:00").cast("timestamp")

    def read(path: str, schema: str, batch: int) -> DataFrame:
        """What the batches before have written; every batch writes, so only the first finds nothing."""
        return spark.read.schema(schema).parquet(path) if batch else spark.createDataFrame([], schema)

    def handle(rows: DataFrame, batch: int) -> None:
        parts = (
            rows.where(not_removed(F.col("is_removed")))
            .groupBy(*_cell_columns(cell), F.date_trunc("hour", "created_at").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(risk_is_high(F.col("risk_level"))).alias("high"))
        )
        before = read(f"{store}/slot={(batch - 1) % 2}", part_schema, batch)
        both = cut(before.unionByName(parts))
        as_of = both.agg(F.max("hour") + F.expr("INTERVAL 1 HOUR")).scalar()
        recent = F.col("hour") > as_of - F.make_dt_interval(F.lit(days))
        totals = both.withColumn("hour", F.when(recent, F.col("hour")).otherwise(old)).groupBy("cell_lat", "cell_lng", "hour").agg(
            F.sum("n").alias("n"), F.sum("high").alias("high"))
        place = f"{store}/slot={batch % 2}"
        totals.write.mode("overwrite").parquet(place)
        counts = spark.read.schema(part_schema).parquet(place)
        cells = counts.where(has_location(F.col("cell_lng"), F.col("cell_lat"))).groupBy("cell_lat", "cell_lng").agg(F.sum("n").alias("n"))
        sums = counts.agg(
            F.coalesce(F.sum(F.when(F.col("hour") > old, F.col("high"))), F.lit(0)).alias("critical_n"),
            F.coalesce(F.sum(F.when(F.col("hour") > old, F.col("n"))), F.lit(0)).alias("recent_n"), F.max("hour").alias("raised_at"),
        ).withColumn("hotspots", cells.agg(F.count_if(F.col("n") >= min_n)).scalar())
        sums.select(F.inline(alert_rows()), "raised_at").write.mode("overwrite").parquet(f"{store}-current/batch={batch}")
        raised = spark.read.parquet(f"{store}-current/batch={batch}").withColumn("dismissed", F.lit(False))
        earlier = read(notifications, note_schema + ", batch long", batch).where(F.col("batch") < batch)
        new = once_per_day(alerts_new(raised, earlier), earlier)
        new.select("level", "title", "description", "action", "dismissed", "raised_at").write.mode("overwrite").parquet(f"{notifications}/batch={batch}")

    query = (
        src.writeStream.option("checkpointLocation", f"{store}/_state").trigger(availableNow=True).foreachBatch(handle).start()
    )
    query.awaitTermination()
