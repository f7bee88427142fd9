"""Queries that run a stream over the event files, and image tables built from the vectors."""

from pyspark.sql import functions as F

from sightline.functions.risk import risk_is_high
from sightline.operators import images
from sightline.operators.updates import apply_analysis
from sightline.registry.base import S, query, rounded
from sightline.registry.dashboard import ALERTS, HIGH
from sightline.registry.places import ACTIVE, CELLS4, CODES, PLACED, SPECIES, cell
from sightline.session import new_path
from sightline.sources import readers, tables as tb
from sightline.streaming import feeds


SLICES = 3


def live(spark, d, build, mode, label):
    """Changes of a stream over the sightings, which arrive in slices of time.

    After each slice the stream is started anew on the same folders and goes on from where it stopped.
    """
    events, source, out = tb.table(spark, d, "events"), new_path(spark, "events"), new_path(spark, label)
    for rows in slices(events):
        rows.write.mode("append").parquet(source)
        changes = feeds.run_to_table(build(sightings_stream(spark, source, events.schema)), mode, out)
    return changes


def slices(events):
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / SLICES for k in range(1, SLICES)]
    part = sum((F.when(F.col("ts") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return [events.where(F.coalesce(part, F.lit(0)) == k) for k in range(SLICES)]


def sightings_stream(spark, source, schema):
    return spark.sql(tb.SIGHTINGS, events=spark.readStream.schema(schema).parquet(source))


@query("stream_new_sightings", S("""
SELECT sighting_id, coalesce(nullif(predicted_species,''),'Unknown species') AS predicted_species, round(coalesce(lng,0),6) AS lng, 'pending' AS llm_status FROM sightings"""))
def stream_new_sightings(spark, d):
    out = live(spark, d, feeds.stream_new_sightings, "append", "new-sightings")
    return rounded(out.select("sighting_id", "predicted_species", "lng", "llm_status"), "lng")


@query("stream_status", S(f"""
SELECT sighting_id, CASE WHEN sighting_id % 8 = 0 THEN 'failed' WHEN sighting_id % 4 = 0 THEN 'completed' ELSE llm_status END AS llm_status,
 CASE WHEN sighting_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS changes, CASE WHEN sighting_id % 4 = 0 AND sighting_id % 8 <> 0 THEN 1 ELSE 0 END::BIGINT AS done_events FROM sightings"""))
def stream_status(spark, d):
    """Results come with their sighting; in the next slice some come again, and some older ones say the opposite."""
    sightings, source, out = tb.sightings(spark, d), new_path(spark, "results"), new_path(spark, "status")
    status, other = [F.when((F.col("sighting_id") % 8 == 0) == same, "failed").otherwise("completed") for same in (True, False)]

    def results(rows, which, hours):
        return rows.select("sighting_id", which.alias("status"), F.lit("Low").alias("risk_level"), (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("ts"))

    parts = [spark.sql(tb.SIGHTINGS, events=rows).where("sighting_id % 4 = 0") for rows in slices(tb.table(spark, d, "events"))]
    own = [results(p, status, 0) for p in parts]
    again = [results(p.where("sighting_id % 3 = 0"), status, 2).union(results(p.where("sighting_id % 5 = 0"), other, -1)) for p in parts]
    for rows in [own[0], *[a.union(b) for a, b in zip(own[1:], again)], again[-1]]:
        rows.write.mode("append").parquet(source)
        changes = feeds.run_to_table(feeds.stream_status(spark.readStream.schema(rows.schema).parquet(source)), "append", out)
    seen = changes.groupBy("sighting_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("event") == feeds.DONE).alias("done_events"))
    now = apply_analysis(sightings, changes, "ts").select("sighting_id", "llm_status")
    return now.join(seen, "sighting_id", "left").fillna(0, ["changes", "done_events"])


@query("stream_daily_alerts", S(f"""SELECT predicted_species AS type, strftime(created_at,'%Y-%m-%d') AS day, arg_min(sighting_id, (created_at, sighting_id)) AS alert_id
FROM sightings WHERE {HIGH} AND predicted_species IS NOT NULL GROUP BY 1,2"""))
def stream_daily_alerts(spark, d):
    def daily(s):
        high = s.where(risk_is_high(F.col("risk_level")))
        return feeds.stream_daily_alerts(high.select(F.col("predicted_species").alias("type"), F.col("sighting_id").alias("alert_id"), F.col("created_at").alias("raised_at"), F.lit(False).alias("dismissed")))
    return live(spark, d, daily, "append", "daily").select("type", "day", "alert_id")


@query("stream_live_counts", S(f"SELECT strftime(created_at,'%Y-%m-%d') AS day, {SPECIES} AS species, count(*) AS n FROM sightings WHERE {ACTIVE} GROUP BY 1,2"))
def stream_live_counts(spark, d):
    changes = live(spark, d, feeds.stream_live_counts, "update", "live-counts")
    return feeds.latest(changes, ["day", "species"])


@query("stream_code_ttl", S(f"{CODES} SELECT use_id, code FROM j"))
def stream_code_ttl(spark, d):
    def valid(s):
        regs = s.where("predicted_species = 'Unknown species'").select(F.col("owner").alias("code"), F.col("created_at").alias("ts"))
        uses = s.where("predicted_species = 'Bidens_pilosa'").select(F.col("sighting_id").alias("use_id"), F.col("owner").alias("code"), F.col("created_at").alias("ts"))
        return feeds.stream_code_ttl(regs, uses)
    return live(spark, d, valid, "append", "code-ttl").select("use_id", "code")


@query("stream_frame_sample", S("""
SELECT owner, arg_min(sighting_id, created_at) AS sighting_id, strftime(to_timestamp(CAST(floor(epoch_us(created_at)/3e6) AS BIGINT)*3) AT TIME ZONE 'UTC','%Y-%m-%d %H:%M:%S') AS start
FROM sightings GROUP BY owner, CAST(floor(epoch_us(created_at)/3e6) AS BIGINT)"""))
def stream_frame_sample(spark, d):
    changes = live(spark, d, feeds.stream_frame_sample, "update", "frames")
    return feeds.latest(changes, ["start", "owner"]).select("owner", "sighting_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("stream_marker_cells", S(f"{CELLS4} SELECT cell_lat, cell_lng, n, sighting_id AS newest_id FROM r1 WHERE rn = 1"))
def stream_marker_cells(spark, d):
    return feeds.marker_cells(live(spark, d, feeds.stream_marker_cells, "update", "cells")).drop("newest_at")


@query("stream_removals", S(f"""
SELECT {cell('lat','1e-2')} AS cell_lat, {cell('lng','1e-2')} AS cell_lng, CAST(sum(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM sightings WHERE {PLACED} GROUP BY 1,2"""))
def stream_removals(spark, d):
    """A sighting's removal arrives in the slice after its own."""
    events, source, out = tb.table(spark, d, "events"), new_path(spark, "changes"), new_path(spark, "removals")
    parts = [spark.sql(tb.SIGHTINGS, events=rows).select("sighting_id", "lng", "lat", "created_at", "is_removed") for rows in slices(events)]
    added = [p.drop("is_removed").withColumn("delta", F.lit(1)) for p in parts]
    gone = [p.where("is_removed").drop("is_removed").withColumn("delta", F.lit(-1)) for p in parts]
    for rows in [added[0], *[a.union(g) for a, g in zip(added[1:], gone, strict=False)], gone[-1]]:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        changes = feeds.run_to_table(feeds.stream_removals(stream, 0.01), "update", out)
    return feeds.cell_totals(changes)


@query("stream_activity_sessions", S("""
, g AS (SELECT owner, created_at, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM sightings WINDOW w AS (PARTITION BY owner ORDER BY created_at))
, k AS (SELECT owner, created_at, sum(fresh) OVER (PARTITION BY owner ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS no FROM g)
, q AS (SELECT owner, min(created_at) AS a, max(created_at) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM k GROUP BY owner, no)
SELECT owner, strftime(a,'%Y-%m-%d %H:%M:%S') AS start, n FROM q WHERE b <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM sightings)"""))
def stream_activity_sessions(spark, d):
    out = live(spark, d, feeds.stream_activity_sessions, "append", "activity")
    return out.select("owner", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


HOUR_ALERTS = ALERTS.replace(ALERTS[ALERTS.index(", c AS"):ALERTS.index(", al AS")], f"""
, t AS (SELECT *, date_trunc('hour', created_at) > max(date_trunc('hour', created_at)) OVER () + INTERVAL 1 HOUR - INTERVAL 7 DAY AND {ACTIVE} AS rec FROM sightings)
, c AS (SELECT count(*) FILTER (WHERE rec AND {HIGH}) AS cn, count(*) FILTER (WHERE rec) AS rn, (SELECT count(*) FROM (SELECT 1 FROM sightings
 WHERE {ACTIVE} AND {PLACED} GROUP BY floor(lat/1e-2+0.5), floor(lng/1e-2+0.5) HAVING count(*) >= 3)) AS hs FROM t)
""")


@query("stream_alerts", S(HOUR_ALERTS + " SELECT level, title, description FROM al"))
def stream_alerts(spark, d):
    events, source, notes, store = tb.table(spark, d, "events"), new_path(spark, "events"), new_path(spark, "notifications"), new_path(spark, "cell-hours")
    for rows in slices(events):
        rows.write.mode("append").parquet(source)
        feeds.stream_alerts(sightings_stream(spark, source, events.schema), store, notes)
    last = spark.read.parquet(f"{store}-current").select("level", "title", "description", "batch")
    return last.where(F.col("batch") == last.agg(F.max("batch")).scalar()).drop("batch")


# ---- image names ---------------------------------------------------------------------------


@query("augmented_manifest", """WITH p AS (SELECT 'class_' || label AS c, 'class_' || label || '/' || vec_id || '.png' AS path FROM embeddings),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('42|' || path), path) <= 37),
 o AS (SELECT path, row_number() OVER (PARTITION BY c ORDER BY path)-1 AS counter FROM k)
SELECT path, CAST(v AS INTEGER) AS variant, replace(path,'.png','') || '_aug' || v || '_' || counter || '.jpg' AS out_path FROM o, range(1,8) AS r(v)""")
def augmented_manifest(spark, d):
    name = F.concat(F.lit("class_"), F.col("label").cast("string"))
    inventory = tb.table(spark, d, "embeddings").select(F.concat(name, F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), name.alias("class_name"))
    return images.augmented_manifest(inventory).select("path", "variant", "out_path")


# ---- text files written by the job ---------------------------------------------------------


@query("src_class_names", "SELECT CAST(row_number() OVER (ORDER BY b)-1 AS INTEGER) AS class_index, b AS class_name FROM (SELECT DISTINCT p_brand AS b FROM part)")
def src_class_names(spark, d):
    path = new_path(spark, "class-names")
    # one line per class: the list is as long as the number of classes
    tb.table(spark, d, "part").select("p_brand").distinct().repartition(1).sortWithinPartitions("p_brand").write.text(path)
    return readers.read_class_names(spark, path)


@query("src_pages", "SELECT CAST(item_id AS INTEGER) AS page_no, length(text) AS chars FROM benchmark")
def src_pages(spark, d):
    path = new_path(spark, "pages")
    b = tb.table(spark, d, "benchmark")
    b.select(F.col("item_id").alias("page_no"), "text").repartition("page_no").write.partitionBy("page_no").text(path)
    out = readers.read_page_texts(spark, path)
    return out.select("page_no", (F.length("text") - 1).cast("long").alias("chars"))  # the writer ends the last line


@query("src_species_json", "SELECT n_name AS scientific_name, r_name AS family, CAST(n_nationkey AS INTEGER) AS page_hint FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_species_json(spark, d):
    path = new_path(spark, "species-arrays")
    n = tb.table(spark, d, "nation").join(tb.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.struct(F.col("n_name").alias("scientific_name"), F.col("r_name").alias("family"), F.col("n_nationkey").alias("page_hint"))
    files = n.groupBy("r_name").agg(F.to_json(F.collect_list(record)).alias("value"))
    files.repartition("r_name").write.partitionBy("r_name").text(path)
    return readers.read_species_json(spark, path).select("scientific_name", "family", "page_hint")
