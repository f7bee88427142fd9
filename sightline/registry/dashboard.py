"""Queries of the species, invasive, temporal and risk panels."""

from pyspark.sql import functions as F

from sightline.functions import risk as rk, text as tx, times as tm
from sightline.operators import alerts, predicates as p, temporal, threat, updates
from sightline.registry.base import AS_OF_SQL, ORACLES, S, as_of, joined, query, rounded, stamp
from sightline.registry.places import ACTIVE, AGE, PLACED, SPECIES, _diameter_sql
from sightline.sources import tables as tb

NAMED = f"(coalesce(nullif(predicted_species,''),'Unknown') NOT LIKE '%Unknown%')"
TRUTHY = "(coalesce(predicted_species,'') NOT IN ('','Unknown','Unknown species'))"
LOOSE = "(coalesce(predicted_species,'') NOT IN ('','Unknown'))"
HIGH = "coalesce(regexp_matches(lower(risk_level),'high|severe'), false)"


def rows(spark, d):
    return tb.sightings(spark, d)


def pct_sql(x: str) -> str:
    return f"printf('%.1f%%', floor(({x})*100*10.0+0.5)/10.0)"


# ---- predicates ----------------------------------------------------------------------------

for _name, _fn, _sql in [
    ("is_invasive_named", p.is_invasive_named, NAMED), ("is_invasive_truthy", p.is_invasive_truthy, TRUTHY),
    ("is_invasive_loose", p.is_invasive_loose, LOOSE),
]:
    query(_name, S(f"SELECT predicted_species, {_sql} AS hit, count(*) AS n FROM sightings GROUP BY 1,2"))(
        lambda spark, d, fn=_fn: rows(spark, d).groupBy("predicted_species", fn(F.col("predicted_species")).alias("hit")).agg(
            F.count(F.lit(1)).alias("n")))


@query("not_removed", S(f"SELECT sighting_id FROM sightings WHERE {ACTIVE}"))
def not_removed(spark, d):
    return rows(spark, d).where(p.not_removed(F.col("is_removed"))).select("sighting_id")


@query("risk_is_high", S(f"SELECT risk_level, {HIGH} AS hit, count(*) AS n FROM sightings GROUP BY 1,2"))
def risk_is_high(spark, d):
    return rows(spark, d).groupBy("risk_level", rk.risk_is_high(F.col("risk_level")).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


@query("recency_flags", S(f"""
SELECT sighting_id, created_at::DATE = {AS_OF_SQL}::DATE AS is_today, created_at::DATE = {AS_OF_SQL}::DATE - 1 AS is_yesterday,
 created_at >= {AS_OF_SQL} - INTERVAL 7 DAY AS in_week, created_at >= {AS_OF_SQL} - INTERVAL 14 DAY AS in_fortnight FROM sightings"""))
def recency_flags(spark, d):
    return p.recency_flags(rows(spark, d), as_of()).select("sighting_id", "is_today", "is_yesterday", "in_week", "in_fortnight")


@query("valid_code", S("SELECT sighting_id, regexp_matches(CAST(sighting_id*37 AS VARCHAR),'^[0-9]{6}$') AS valid FROM sightings"))
def valid_code(spark, d):
    return rows(spark, d).select("sighting_id", p.valid_code((F.col("sighting_id") * 37).cast("string")).alias("valid"))


@query("normalise_prediction", S("""
SELECT sighting_id, sp AS predicted_species, replace(sp,'_',' ') AS lookup_name, round(coalesce(try_cast(c AS DOUBLE),0),6) AS confidence FROM (
 SELECT sighting_id, CASE WHEN coalesce(predicted_species,'') IN ('','undefined','null') THEN 'Unknown species' ELSE predicted_species END AS sp,
  CASE WHEN sighting_id % 10 = 0 THEN 'undefined' ELSE CAST(confidence AS VARCHAR) END AS c FROM sightings)"""))
def normalise_prediction(spark, d):
    raw = rows(spark, d).select("sighting_id", "predicted_species", F.when(F.col("sighting_id") % 10 == 0, "undefined").otherwise(
        F.col("confidence").cast("string")).alias("confidence"))
    return rounded(p.normalise_prediction(raw).select("sighting_id", "predicted_species", "lookup_name", "confidence"), "confidence")


# ---- species -------------------------------------------------------------------------------


@query("species_stats", S(_diameter_sql("Unknown Species", ACTIVE + " AND", f"""
, a AS (SELECT *, coalesce(nullif(predicted_species,''),'Unknown Species') AS species FROM sightings WHERE {ACTIVE})
SELECT a.species, count(*) AS n, round(sum(coalesce(confidence,0))/count(*)*100,6) AS avg_confidence,
 strftime(min(created_at),'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(created_at),'%Y-%m-%d %H:%M:%S') AS last_seen,
 count(lng) AS locations, round(avg(lat),8) AS avg_lat, round(avg(lng),8) AS avg_lng,
 arg_max(image_path, created_at) FILTER (WHERE image_path IS NOT NULL) AS image_path,
 coalesce(arg_max(risk_level, created_at) FILTER (WHERE risk_level IS NOT NULL),'Unknown') AS risk_level,
 coalesce(arg_max(replace(predicted_species,'_',' '), created_at) FILTER (WHERE sighting_id % 3 = 0 AND predicted_species <> ''),'') AS scientific_name,
 round(coalesce(any_value(s.d),0),6) AS diameter_km FROM a LEFT JOIN spans s USING (species) GROUP BY 1""")))
def species_stats(spark, d):
    named = rows(spark, d).withColumn("scientific_name", F.when(F.col("sighting_id") % 3 == 0, F.replace("predicted_species", F.lit("_"), F.lit(" "))))
    out = threat.species_stats(named).withColumns({"first_seen": stamp("first_seen"), "last_seen": stamp("last_seen")})
    return rounded(rounded(out, "avg_confidence", "diameter_km"), "avg_lat", "avg_lng", digits=8)


@query("invasive_risk", S(f"""
, g AS (SELECT predicted_species, count(*) AS n, bool_or(coalesce(lower(risk_level) LIKE '%severe%', false)) AS severe
 FROM sightings WHERE {ACTIVE} AND {NAMED} GROUP BY 1)
SELECT count(*) FILTER (WHERE n >= 3 OR severe) AS high_risk_species, count(*) AS total_species,
 round(coalesce(sum(n),0)/greatest(count(*),1)::DOUBLE,6) AS avg_sightings FROM g"""))
def invasive_risk(spark, d):
    return rounded(threat.invasive_risk(rows(spark, d)), "avg_sightings")


BAND = """CASE WHEN regexp_matches(lower(coalesce(risk_level,'unknown')),'high|severe') THEN 'high'
 WHEN regexp_matches(lower(coalesce(risk_level,'unknown')),'medium|moderate') THEN 'medium'
 WHEN regexp_matches(lower(coalesce(risk_level,'unknown')),'low|minimal') THEN 'low' ELSE 'unknown' END"""


@query("risk_breakdown", S(f"""
, b AS (SELECT * FROM (VALUES (0,'high'),(1,'medium'),(2,'low'),(3,'unknown')) AS t(band_no, band))
, c AS (SELECT {BAND} AS band, count(*) AS n FROM sightings GROUP BY 1)
SELECT band_no, band, coalesce(n,0) AS n FROM b LEFT JOIN c USING (band)"""))
def risk_breakdown(spark, d):
    return threat.risk_breakdown(rows(spark, d))


@query("risk_class", S(f"SELECT 'risk-' || {BAND} AS risk_class, count(*) AS n FROM sightings GROUP BY 1"))
def risk_class(spark, d):
    return rows(spark, d).groupBy(rk.risk_class(F.col("risk_level")).alias("risk_class")).agg(F.count(F.lit(1)).alias("n"))


DAILY = f"""
, c AS (SELECT count(*) FILTER (WHERE t AND created_at::DATE = d) AS nt, count(*) FILTER (WHERE t AND created_at::DATE = d-1) AS ny,
 count(*) FILTER (WHERE removed_at::DATE = d) AS rt, count(*) FILTER (WHERE removed_at::DATE = d-1) AS ry,
 count(*) FILTER (WHERE {LOOSE} AND {PLACED}) AS placed, count(*) FILTER (WHERE t) AS act,
 count(*) FILTER (WHERE coalesce(is_removed,false)) AS rem, count(*) FILTER (WHERE {TRUTHY}) AS inv
 FROM (SELECT *, {AS_OF_SQL}::DATE AS d, {TRUTHY} AND {ACTIVE} AS t FROM sightings))"""


@query("invasive_daily", S(f"""{DAILY}
, l AS (SELECT *, CASE WHEN nt >= 5 THEN 'high' WHEN nt >= 2 THEN 'medium' ELSE 'low' END AS lv FROM c)
SELECT nt AS new_today, ny AS new_yesterday, rt AS removals_today, ry AS removals_yesterday, act AS active_invasives, lv AS threat_level,
 CASE lv WHEN 'high' THEN 'Critical invasion detected! ' || nt || ' new invasive species found. Immediate intervention required.'
  WHEN 'medium' THEN 'Moderate threat level. ' || nt || ' invasive species detected. Increase monitoring and prepare control measures.'
  ELSE CASE WHEN nt > 0 THEN 'Low threat level. ' || nt || ' invasive species detected. Continue regular monitoring.'
   ELSE 'No new invasive species detected today. Maintain vigilance.' END END
  || CASE WHEN rt > 0 THEN ' Great job removing ' || rt || ' plant' || CASE WHEN rt > 1 THEN 's' ELSE '' END || ' today!' ELSE '' END AS recommendation,
 array_to_string(list_filter([CASE WHEN nt > 0 THEN 'Inspect ' || nt || ' new invasive detection' || CASE WHEN nt > 1 THEN 's' ELSE '' END END,
  CASE WHEN nt >= 5 THEN 'Consider emergency herbicide application' END, CASE WHEN nt >= 5 THEN 'Alert neighboring farmers' END,
  CASE WHEN nt > ny THEN 'Increase monitoring frequency' END,
  CASE WHEN nt = 0 AND nt <= ny THEN 'Continue regular monitoring schedule' END], lambda x: x IS NOT NULL), '; ') AS actions,
 CASE WHEN nt > ny THEN '↗ +' || (nt-ny) || ' from yesterday' WHEN nt < ny THEN '↘ -' || (ny-nt) || ' from yesterday' ELSE '→ Same as yesterday' END AS trend,
 CASE WHEN rt > ry THEN '↗ +' || (rt-ry) || ' from yesterday' WHEN rt < ry THEN '↘ -' || (ry-rt) || ' from yesterday'
  WHEN rt = 0 THEN '→ No activity' ELSE '→ Same as yesterday' END AS removal_trend,
 CAST(greatest(1, floor(placed/5.0::DOUBLE)) AS BIGINT) AS hotspot_count,
 CAST(CASE WHEN inv > 0 THEN floor(rem/inv::DOUBLE*100) ELSE 0 END AS BIGINT) AS control_effectiveness FROM l"""))
def invasive_daily(spark, d):
    return threat.invasive_daily(rows(spark, d), as_of())


def _bands(a, b, c, d, e):
    return f"CASE WHEN n >= 20 THEN '{a}' WHEN n >= 10 THEN '{b}' WHEN n >= 5 THEN '{c}' WHEN n >= 1 THEN '{d}' ELSE '{e}' END"


@query("environmental_impact", S(f"""{DAILY}
SELECT n AS active_invasives, {_bands('Critical','High','Moderate','Low','Minimal')} AS severity,
 {_bands('Severe ecosystem disruption imminent','Significant environmental degradation occurring','Noticeable ecological impact developing',
         'Early-stage environmental pressure','No active invasive threats detected')} AS description,
 {_bands('Immediate intervention required','Urgent action needed within 48 hours','Action recommended within 1 week',
         'Monitor and plan removal strategy','Continue monitoring')} AS urgency,
 CASE WHEN nt > 3 THEN 'Accelerating degradation' WHEN nt > 1 THEN 'Steady environmental pressure'
  WHEN nt = 1 THEN 'New environmental threat detected' ELSE 'No new environmental threats today' END AS daily_trend,
 printf('%.2f', floor(n*0.25::DOUBLE*100+0.5)/100) AS area_ha, CAST(floor(n*3.5::DOUBLE+0.5) AS BIGINT) AS water_l,
 CAST(floor(n*pi()*4+0.5) AS BIGINT) AS soil_m2, CAST(floor(n*1.8::DOUBLE+0.5) AS BIGINT) AS displaced,
 CAST(floor(n*12+0.5) AS BIGINT) AS carbon_kg, round(least(100.0::DOUBLE, n*4.2::DOUBLE),6) AS risk_score
FROM (SELECT act AS n, nt FROM c)"""))
def environmental_impact(spark, d):
    return rounded(threat.environmental_impact(threat.invasive_daily(rows(spark, d), as_of())), "risk_score")


@query("pair_overview", S(f"""
SELECT count(*) FILTER (WHERE {NAMED}) AS named, count(*) FILTER (WHERE NOT {NAMED}) AS unknown,
 round(count(*) FILTER (WHERE {NAMED})/count(*)::DOUBLE*100,6) AS named_share FROM sightings WHERE {ACTIVE}"""))
def pair_overview(spark, d):
    return rounded(threat.pair_overview(rows(spark, d)), "named_share")


@query("unknown_summary", S(f"""
SELECT count(*) FILTER (WHERE u) AS n, round(count(*) FILTER (WHERE u)/count(*)::DOUBLE*100,6) AS share,
 count(DISTINCT CASE WHEN u THEN {SPECIES} END) AS labels FROM (SELECT *, NOT {NAMED} AND {ACTIVE} AS u FROM sightings)"""))
def unknown_summary(spark, d):
    return rounded(threat.unknown_summary(rows(spark, d)), "share")


@query("unknown_newest", S(f"""
SELECT sighting_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at, {pct_sql('coalesce(confidence,0)')} AS confidence
FROM sightings WHERE {ACTIVE} AND NOT {NAMED} ORDER BY sightings.created_at DESC, sighting_id LIMIT 10"""))
def unknown_newest(spark, d):
    return threat.unknown_newest(rows(spark, d)).select("sighting_id", stamp("created_at").alias("created_at"), "confidence")


@query("split_named_unknown", S(f"SELECT CASE WHEN {NAMED} THEN 'named' ELSE 'unknown' END AS part, count(*) AS n FROM sightings GROUP BY 1"))
def split_named_unknown(spark, d):
    named, unknown = threat.split_named_unknown(rows(spark, d))
    parts = named.withColumn("part", F.lit("named")).unionByName(unknown.withColumn("part", F.lit("unknown")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---- lists ---------------------------------------------------------------------------------


@query("sightings_list", S(f"""
SELECT sighting_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at FROM sightings
WHERE owner = 7 AND {ACTIVE} AND lng BETWEEN 28e0 AND 28.2e0 AND lat BETWEEN -26e0 AND -25.8e0
ORDER BY sightings.created_at DESC, sighting_id LIMIT 200"""))
def sightings_list(spark, d):
    out = threat.sightings_list(rows(spark, d), 7, (28.0, -26.0, 28.2, -25.8))
    return out.select("sighting_id", stamp("created_at").alias("created_at"))


@query("invasive_first", S(f"""
SELECT sighting_id, {NAMED} AS is_invasive, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at FROM sightings"""))
def invasive_first(spark, d):
    return threat.invasive_first(rows(spark, d)).select("sighting_id", "is_invasive", stamp("created_at").alias("created_at"))


URGENCY = """CASE WHEN lower(coalesce(nullif(risk_level,''),'Medium')) LIKE '%high%' THEN 'Immediate inspection required - High threat species'
 WHEN lower(coalesce(nullif(risk_level,''),'Medium')) LIKE '%medium%' THEN CASE WHEN coalesce(nullif(confidence,0),0.5) > 0.8
  THEN 'Monitor closely - Confirmed invasive' ELSE 'Verify identification - Possible invasive' END
 ELSE 'Routine monitoring - Low immediate threat' END"""
COLOR = """CASE WHEN lower(coalesce(nullif(risk_level,''),'Medium')) LIKE '%high%' THEN '#dc2626'
 WHEN lower(coalesce(nullif(risk_level,''),'Medium')) LIKE '%medium%' THEN '#d97706' ELSE '#059669' END"""


@query("threat_feed", S(f"""
SELECT sighting_id, predicted_species, upper(coalesce(risk_level,'Medium')) || ' RISK' AS badge, {URGENCY} AS urgency, {COLOR} AS color,
 {pct_sql('coalesce(confidence,0)')} AS confidence FROM sightings s WHERE {NAMED} ORDER BY s.created_at DESC, sighting_id LIMIT 12"""))
def threat_feed(spark, d):
    return threat.threat_feed(rows(spark, d))


@query("threat_urgency", S(f"SELECT sighting_id, {URGENCY} AS urgency, {COLOR} AS color FROM sightings"))
def threat_urgency(spark, d):
    return rows(spark, d).select("sighting_id", rk.threat_urgency(F.col("risk_level"), F.col("confidence")).alias("urgency"),
                                 rk.threat_color(F.col("risk_level")).alias("color"))


@query("sighting_color", S(f"""
SELECT sighting_id, CASE WHEN NOT {NAMED} THEN '#10b981' ELSE {AGE} END AS color
FROM (SELECT *, (epoch_us({AS_OF_SQL})-epoch_us(created_at))/86400e6/30 AS r FROM sightings)"""))
def sighting_color(spark, d):
    return rows(spark, d).select("sighting_id", rk.sighting_color(F.col("predicted_species"), F.col("created_at"), as_of()).alias("color"))


@query("analysis_label", S("""
SELECT llm_status, CASE llm_status WHEN 'pending' THEN 'Processing...' WHEN 'failed' THEN 'Analysis failed' ELSE 'No analysis available' END AS label,
 count(*) AS n FROM sightings GROUP BY 1,2"""))
def analysis_label(spark, d):
    return rows(spark, d).groupBy("llm_status", tx.analysis_label(F.col("llm_status")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("label_short", S(f"SELECT {SPECIES} AS species, CASE WHEN length({SPECIES}) > 12 THEN substr({SPECIES},1,12) || '...' ELSE {SPECIES} END AS label, count(*) AS n FROM sightings GROUP BY 1,2"))
def label_short(spark, d):
    sp = F.coalesce(F.nullif("predicted_species", F.lit("")), F.lit("Unknown"))
    return rows(spark, d).groupBy(sp.alias("species"), tx.label_short(sp).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---- time ----------------------------------------------------------------------------------

WEEK = "strftime(created_at::DATE - CAST(dayofweek(created_at) AS INTEGER), '%Y-%m-%d')"
KEYS = {
    "hour": "strftime(created_at,'%H')", "daily": "strftime(created_at,'%Y-%m-%d')", "weekly": WEEK,
    "monthly": "strftime(created_at,'%Y-%m')", "yearly": "strftime(created_at,'%Y')",
}
PERIODS = "\nUNION ALL ".join(f"SELECT '{k}' AS period, {v} AS key, count(*) AS n FROM sightings WHERE {ACTIVE} GROUP BY 2" for k, v in KEYS.items())
COUNTS = f", pc AS ({PERIODS})"


@query("time_patterns", S(f"""{COUNTS}
SELECT 'hour' AS period, printf('%02d', h.i) AS key, coalesce(n,0) AS n FROM range(24) AS h(i) LEFT JOIN pc ON period = 'hour' AND key = printf('%02d', h.i)
UNION ALL SELECT * FROM pc WHERE period <> 'hour'"""))
def time_patterns(spark, d):
    return temporal.time_patterns(rows(spark, d))


@query("peak_hour", S(f"""{COUNTS}
SELECT CAST((SELECT key FROM pc WHERE period = 'hour' ORDER BY n DESC, key LIMIT 1) AS INTEGER) AS peak_hour,
 (SELECT count(*) FROM pc WHERE period = 'daily') AS total_days"""))
def peak_hour(spark, d):
    return temporal.peak_hour(rows(spark, d))


@query("hourly_every_third", S(f"""{COUNTS}, h AS (SELECT CAST(i AS INTEGER) AS hour, coalesce(n,0) AS n FROM range(24) AS r(i)
 LEFT JOIN pc ON period = 'hour' AND CAST(key AS INTEGER) = i)
SELECT hour, n, hour = (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS is_peak FROM h WHERE hour % 3 = 0"""))
def hourly_every_third(spark, d):
    return temporal.hourly_every_third(rows(spark, d))


for _period, _keep in (("daily", 7), ("weekly", 6), ("monthly", 6), ("yearly", 3)):
    query(f"recent_buckets_{_period}", S(f"{COUNTS} SELECT key, n FROM pc WHERE period = '{_period}' ORDER BY key DESC LIMIT {_keep}"))(
        lambda spark, d, period=_period: temporal.recent_buckets(rows(spark, d), period))


@query("week_start", S(f"SELECT sighting_id, {WEEK} AS week, {KEYS['monthly']} AS month, {KEYS['yearly']} AS year, {KEYS['daily']} AS day FROM sightings"))
def week_start(spark, d):
    ts = F.col("created_at")
    return rows(spark, d).select("sighting_id", tm.week_key(ts).alias("week"), tm.month_key(ts).alias("month"), tm.year_key(ts).alias("year"),
                                 tm.day_key(ts).alias("day"))


@query("trends", S(f"""
, c AS (SELECT count(*) FILTER (WHERE created_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS a,
 count(*) FILTER (WHERE created_at >= {AS_OF_SQL} - INTERVAL 14 DAY AND created_at < {AS_OF_SQL} - INTERVAL 7 DAY) AS b,
 count(*) AS n, min(created_at) AS o FROM sightings)
SELECT a AS this_week, b AS last_week, round((a+b)/2.0::DOUBLE,6) AS weekly_average,
 round(CASE WHEN b > 0 THEN (a-b)/b::DOUBLE*100 ELSE 0 END,6) AS weekly_change,
 round(n/greatest((epoch_us({AS_OF_SQL})-epoch_us(o))/86400e6,1),6) AS detection_rate FROM c"""))
def trends(spark, d):
    return rounded(temporal.trends(rows(spark, d), as_of()), "weekly_average", "weekly_change", "detection_rate")


SEASON = """CASE WHEN month(created_at) BETWEEN 3 AND 5 THEN 0 WHEN month(created_at) BETWEEN 6 AND 8 THEN 1
 WHEN month(created_at) BETWEEN 9 AND 11 THEN 2 ELSE 3 END"""
SEASONS_SQL = f"""
, b AS (SELECT * FROM (VALUES (0,'Spring'),(1,'Summer'),(2,'Fall'),(3,'Winter')) AS t(season_no, season))
, c AS (SELECT SHIFTED AS season_no, count(*) AS n FROM sightings WHERE {ACTIVE} GROUP BY 1)
, f AS (SELECT b.season_no, season, coalesce(n,0) AS n FROM b LEFT JOIN c USING (season_no))
SELECT season_no, season, n, season_no = (SELECT season_no FROM f ORDER BY n DESC, season_no DESC LIMIT 1) AS dominant FROM f"""


@query("seasonal_patterns", S(SEASONS_SQL.replace("SHIFTED", SEASON)))
def seasonal_patterns(spark, d):
    return temporal.seasonal_patterns(rows(spark, d))


@query("seasonal_patterns_south", S(SEASONS_SQL.replace("SHIFTED", f"({SEASON} + 2) % 4")))
def seasonal_patterns_south(spark, d):
    return temporal.seasonal_patterns(rows(spark, d), "south")


def timeline_sql(period: str, keep: int, where: str, columns: str) -> str:
    return S(f"""
, r AS (SELECT {KEYS[period]} AS period, {SPECIES} AS species, created_at, sighting_id, is_removed, {TRUTHY} AND {ACTIVE} AS living,
  lower(coalesce(nullif(risk_level,''),'Medium')) AS risk FROM sightings WHERE {where})
, sp AS (SELECT period, species, row_number() OVER (PARTITION BY period ORDER BY t DESC, i) AS k FROM (
  SELECT period, species, max(created_at) AS t, arg_max(sighting_id, created_at) AS i FROM r GROUP BY 1,2))
, sl AS (SELECT period, list(species ORDER BY k) AS species FROM sp GROUP BY 1)
, g AS (SELECT period, count(*) AS n, count(*) FILTER (WHERE risk LIKE '%high%') AS high, count(*) FILTER (WHERE risk LIKE '%medium%') AS medium,
  count(*) FILTER (WHERE living) AS living, count(*) FILTER (WHERE coalesce(is_removed,false)) AS removed FROM r GROUP BY 1)
SELECT period, n, {columns} FROM g JOIN sl USING (period) ORDER BY period DESC LIMIT {keep}""")


AVG_RISK = "CASE WHEN high > n/2.0::DOUBLE THEN 'High' WHEN medium > n/3.0::DOUBLE THEN 'Medium' ELSE 'Low' END"
FACTOR = "CASE CAST(substr(period,6,2) AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tm.SEASONAL_FACTORS.items()) + " END"


@query("timeline_weekly", timeline_sql("weekly", 6, NAMED, f"""array_to_string(species,'|') AS species, {AVG_RISK} AS avg_risk,
 CASE WHEN n > 5 THEN 'Increase herbicide application|' ELSE '' END || CASE WHEN n > 2 THEN 'Deploy monitoring equipment|' ELSE '' END
 || 'Update control strategy' AS actions"""))
def timeline_weekly(spark, d):
    return temporal.timeline_weekly(rows(spark, d)).withColumns({"species": joined("species"), "actions": joined("actions")})


@query("timeline_monthly", timeline_sql("monthly", 4, NAMED, f"""array_to_string(species,'|') AS species,
 CASE WHEN living >= 15 THEN 'Critical' WHEN living >= 8 THEN 'High' WHEN living >= 4 THEN 'Moderate' WHEN living >= 1 THEN 'Low' ELSE 'Minimal' END AS severity,
 {FACTOR} AS seasonal_factor"""))
def timeline_monthly(spark, d):
    return temporal.timeline_monthly(rows(spark, d)).withColumn("species", joined("species"))


@query("timeline_yearly", timeline_sql("yearly", 3, NAMED, """array_to_string(species,'|') AS species, removed,
 CASE WHEN removed = 0 THEN 'No ecosystem recovery data available - no removal activities recorded' ELSE
 'Ecosystem recovery: ' || printf('%.1f', floor(removed/n::DOUBLE*100*10+0.5)/10) || '% invasive removal restored '
 || CAST(floor(removed*2.3::DOUBLE+0.5) AS BIGINT) || ' hectares, enabling ' || CAST(floor(removed*1.8::DOUBLE+0.5) AS BIGINT) || ' native species return' END AS recovery"""))
def timeline_yearly(spark, d):
    return temporal.timeline_yearly(rows(spark, d)).withColumn("species", joined("species"))


for _period, _keep, _text in (
    ("weekly", 8, "array_to_string(species[1:3], ', ')"), ("monthly", 6, "array_to_string(species[1:2], ', ')"),
    ("yearly", 5, "len(species) || ' unique species'"),
):
    query(f"timeline_all_{_period}", timeline_sql(_period, _keep, "true", f"{_text} AS species"))(
        lambda spark, d, period=_period: temporal.timeline_all(rows(spark, d), period))


@query("avg_risk", timeline_sql("daily", 100000, "true", f"{AVG_RISK} AS avg_risk"))
def avg_risk(spark, d):
    return temporal.avg_risk_by(rows(spark, d), "daily")


@query("distinct_species", S(f"""
SELECT {KEYS['weekly']} AS period, CAST(count(DISTINCT {SPECIES}) AS INTEGER) AS n_species,
 array_to_string(list_sort(list(DISTINCT {SPECIES})),'|') AS species FROM sightings GROUP BY 1"""))
def distinct_species(spark, d):
    return temporal.distinct_species(rows(spark, d), "weekly").withColumn("species", joined("species"))


# ---- alerts --------------------------------------------------------------------------------


def _spots(where: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT 1 FROM sightings WHERE {ACTIVE} AND {PLACED} AND {where}
 GROUP BY floor(lat/1e-2+0.5), floor(lng/1e-2+0.5) HAVING count(*) >= 3))"""


ALERTS = f"""
, c AS (SELECT count(*) FILTER (WHERE rec AND {HIGH}) AS cn, count(*) FILTER (WHERE rec) AS rn, {_spots('true')} AS hs
 FROM (SELECT *, {ACTIVE} AND (epoch_us({AS_OF_SQL})-epoch_us(created_at))/86400e6 < 7 AS rec FROM sightings))
, al AS (SELECT 'critical' AS level, 'New Invasive Species Detected' AS title,
  cn || ' high-risk invasive species sightings in the past week. Immediate containment required.' AS description, 'Deploy containment teams' AS action FROM c WHERE cn > 0
 UNION ALL SELECT 'warning', 'Species Concentration Detected', hs || ' hotspots identified with high species concentration. Monitor for potential spreading.',
  'Increase surveillance' FROM c WHERE hs > 0
 UNION ALL SELECT 'info', 'Low Detection Activity', 'Detection activity below normal levels. Consider increasing monitoring efforts.',
  'Schedule additional surveys' FROM c WHERE rn < 5)"""


@query("risk_alerts", S(ALERTS + " SELECT * FROM al"))
def risk_alerts(spark, d):
    return alerts.risk_alerts(rows(spark, d), as_of())


@query("priorities", S(f"""
SELECT {_spots(HIGH)} AS high_priority, greatest(0, {_spots('true')} - {_spots(HIGH)}) AS medium_priority, CAST(0 AS BIGINT) AS low_priority"""))
def priorities(spark, d):
    return alerts.priorities(rows(spark, d))


@query("recommendations", S(f"""
, c AS (SELECT count(*) FILTER (WHERE {HIGH}) AS hn, {_spots('true')} AS hs FROM sightings)
SELECT 'Immediate Invasive Species Control' AS title, 'Deploy control measures for ' || hn ||
 ' detected invasive species. Focus on early detection and rapid response protocols.' AS description, 'High' AS priority, 'Critical' AS impact FROM c WHERE hn > 0
UNION ALL SELECT 'Enhanced Monitoring in Hotspots', 'Increase surveillance frequency in ' || hs || ' identified hotspot areas to track species spread patterns.',
 'Medium', 'High' FROM c WHERE hs > 0
UNION ALL SELECT 'Community Engagement Program', 'Expand citizen science participation to increase detection coverage and early warning capabilities.', 'Medium', 'Medium'"""))
def recommendations(spark, d):
    return alerts.recommendations(rows(spark, d))


# stored notifications: one per sighting with a risk, the type from its parity
NOTES = """
SELECT CAST(sighting_id AS VARCHAR) AS id, CASE WHEN sighting_id % 2 = 0 THEN 'risk' ELSE 'weather' END AS type,
 coalesce(predicted_species,'Species') || ' Detected' AS title, 'Seen by owner ' || owner || ' in lot ' || (sighting_id % 97) AS description,
 CASE risk_level WHEN 'High' THEN 'critical' WHEN 'Medium' THEN 'warning' ELSE 'info' END AS level,
 sighting_id % 3 = 0 AS dismissed FROM sightings WHERE risk_level IS NOT NULL"""


def notes(spark, d):
    return spark.sql(NOTES.replace("VARCHAR", "STRING").replace("FROM sightings", "FROM {s}"), s=rows(spark, d))


def completed(spark, d):
    return rows(spark, d).where("sighting_id % 5 = 0").select(F.col("sighting_id").cast("string").alias("id"))


def candidate_alerts(spark, d):
    """Alerts to raise: the distinct texts of critical notifications, dismissed or not."""
    return notes(spark, d).where("level = 'critical'").select("level", "title", "description").distinct()


NOTE_CTE = f", notes AS ({NOTES}), done AS (SELECT CAST(sighting_id AS VARCHAR) AS id FROM sightings WHERE sighting_id % 5 = 0), " \
           "cand AS (SELECT DISTINCT level, title, description FROM notes WHERE level = 'critical')"


@query("alerts_new", S(f"""{NOTE_CTE}
SELECT level, title, description FROM cand c WHERE NOT EXISTS (
 SELECT 1 FROM notes n WHERE NOT n.dismissed AND n.title = c.title AND n.description = c.description)"""))
def alerts_new(spark, d):
    return alerts.alerts_new(candidate_alerts(spark, d), notes(spark, d)).select("level", "title", "description")


@query("alerts_open", S(f"{NOTE_CTE} SELECT id, type, title, level FROM notes WHERE id NOT IN (SELECT id FROM done)"))
def alerts_open(spark, d):
    return alerts.alerts_open(notes(spark, d), completed(spark, d)).select("id", "type", "title", "level")


@query("alert_feed", S(f"""{NOTE_CTE}{ALERTS}
, st AS (SELECT * FROM notes n WHERE NOT dismissed AND id NOT IN (SELECT id FROM done)
  AND NOT EXISTS (SELECT 1 FROM al WHERE al.title = n.title AND al.description = n.description))
, u AS (SELECT level, title, description, 0 AS stored FROM al UNION ALL SELECT level, title, description, 1 FROM st)
SELECT CAST((CASE level WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END)*2 + stored AS BIGINT) AS rank, level, title, description, stored FROM u"""))
def alert_feed(spark, d):
    return alerts.alert_feed(alerts.risk_alerts(rows(spark, d), as_of()), notes(spark, d), completed(spark, d))


@query("notification_badges", S(f"""{NOTE_CTE}
, c AS (SELECT count(*) FILTER (WHERE type = 'risk' AND NOT dismissed) AS r, count(*) FILTER (WHERE type = 'weather' AND NOT dismissed) AS w FROM notes)
SELECT r AS risk, w AS weather, r+w AS total, CASE WHEN r > 0 THEN 'danger' WHEN w > 0 THEN 'info' END AS badge FROM c"""))
def notification_badges(spark, d):
    return alerts.notification_badges(notes(spark, d))


# ---- updates -------------------------------------------------------------------------------


@query("append_sightings", S("""
SELECT sighting_id, coalesce(from_video, false) AS from_video, round(coalesce(lng,0),6) AS lng, round(coalesce(lat,0),6) AS lat,
 coalesce(nullif(predicted_species,''),'Unknown species') AS predicted_species, round(coalesce(confidence,0),6) AS confidence, 'pending' AS llm_status
FROM sightings"""))
def append_sightings(spark, d):
    raw = rows(spark, d).withColumns({c: F.col(c).cast("string") for c in ("from_video", "lng", "lat", "confidence")})
    out = updates.new_sightings(raw).select("sighting_id", "from_video", "lng", "lat", "predicted_species", "confidence", "llm_status")
    return rounded(out, "lng", "lat", "confidence")


@query("apply_analysis_results", S("""
, r AS (SELECT sighting_id, CASE WHEN sighting_id % 8 = 0 THEN 'failed' ELSE 'completed' END AS status, 'Low' AS risk FROM sightings WHERE sighting_id % 4 = 0)
SELECT s.sighting_id, coalesce(r.status, llm_status) AS llm_status, CASE WHEN r.status = 'completed' THEN r.risk ELSE risk_level END AS risk_level
FROM sightings s LEFT JOIN r USING (sighting_id)"""))
def apply_analysis_results(spark, d):
    s = rows(spark, d)
    results = s.where("sighting_id % 4 = 0").select("sighting_id", F.when(F.col("sighting_id") % 8 == 0, "failed").otherwise("completed").alias("status"),
                                                    F.lit("Low").alias("risk_level"))
    results = results.withColumn("ts", F.lit(2)).union(results.where("sighting_id % 3 = 0").selectExpr("sighting_id", "'completed'", "'High'", "1"))
    return updates.apply_analysis(s, results, "ts").select("sighting_id", "llm_status", "risk_level")


REMOVALS = """, rm AS (SELECT sighting_id + CASE WHEN sighting_id % 26 = 0 THEN 100000000 ELSE 0 END AS sighting_id, owner, NULL::VARCHAR AS removed_by
 FROM sightings WHERE sighting_id % 13 = 0)"""


def _removals(s):
    far = F.when(F.col("sighting_id") % 26 == 0, 100000000).otherwise(0)
    return s.where("sighting_id % 13 = 0").select((F.col("sighting_id") + far).alias("sighting_id"), "owner",
                                                  F.lit(None).cast("timestamp").alias("removed_at"), F.lit(None).cast("string").alias("removed_by"))


@query("mark_removed", S(f"""{REMOVALS}
SELECT s.sighting_id, r.sighting_id IS NOT NULL OR coalesce(is_removed,false) AS is_removed,
 strftime(CASE WHEN r.sighting_id IS NOT NULL THEN {AS_OF_SQL} ELSE s.removed_at END,'%Y-%m-%d %H:%M:%S') AS removed_at,
 CASE WHEN r.sighting_id IS NOT NULL THEN 'user' ELSE s.removed_by END AS removed_by
FROM sightings s LEFT JOIN rm r USING (sighting_id, owner)"""))
def mark_removed(spark, d):
    s = rows(spark, d)
    twice = _removals(s).union(_removals(s))
    return updates.mark_removed(s, twice, as_of()).select("sighting_id", "is_removed", stamp("removed_at").alias("removed_at"), "removed_by")


@query("removals_not_found", S(f"{REMOVALS} SELECT sighting_id, owner FROM rm WHERE (sighting_id, owner) NOT IN (SELECT (sighting_id, owner) FROM sightings)"))
def removals_not_found(spark, d):
    s = rows(spark, d)
    return updates.removals_not_found(s, _removals(s)).select("sighting_id", "owner")


# ---- the five dashboards -------------------------------------------------------------------

PANELS = {
    ("species", "stats"): "species_stats", ("invasive", "overview"): "pair_overview", ("invasive", "risk"): "invasive_risk",
    ("invasive", "breakdown"): "risk_breakdown", ("invasive", "unknown"): "unknown_summary", ("geographic", "clusters"): "leader_clusters",
    ("geographic", "density"): "density_summary", ("geographic", "distances"): "distance_histogram",
    ("geographic", "counts"): "species_count_top", ("geographic", "ranges"): "species_range_top", ("temporal", "patterns"): "time_patterns",
    ("temporal", "trends"): "trends", ("temporal", "seasons"): "seasonal_patterns", ("temporal", "daily"): "invasive_daily",
    ("temporal", "impact"): "environmental_impact", ("temporal", "weekly"): "timeline_weekly", ("temporal", "monthly"): "timeline_monthly",
    ("temporal", "yearly"): "timeline_yearly", ("risk", "alerts"): "risk_alerts", ("risk", "priorities"): "priorities",
    ("risk", "recommendations"): "recommendations",
}
OWN_PANELS = {
    ("invasive", "hotspots"): f"SELECT 1 FROM sightings WHERE {ACTIVE} AND {PLACED} AND {NAMED} GROUP BY floor(lat/1e-2+0.5), floor(lng/1e-2+0.5) HAVING count(*) >= 3",
    ("invasive", "spread"): "SELECT 1", ("geographic", "coverage"): "SELECT 1",
}


def _dashboards_sql() -> str:
    parts = [f"SELECT '{a}' AS dashboard, '{b}' AS panel, (SELECT count(*) FROM ({ORACLES[name]})) AS n" for (a, b), name in PANELS.items()]
    parts += [f"SELECT '{a}', '{b}', (SELECT count(*) FROM ({S(text)}))" for (a, b), text in OWN_PANELS.items()]
    return " UNION ALL ".join(parts)


@query("dashboards", _dashboards_sql())
def dashboards(spark, d):
    from sightline.plans.dashboards import dashboards as build

    counts = [
        panel.agg(F.count(F.lit(1)).alias("n")).select(F.lit(board).alias("dashboard"), F.lit(name).alias("panel"), "n")
        for board, panels in build(rows(spark, d), as_of()).items() for name, panel in panels.items()
    ]
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole
