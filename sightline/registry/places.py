"""Queries over located sightings."""

from pyspark.sql import functions as F

from sightline.functions.geo import format_latlng, grid_cell, haversine_km
from sightline.operators import clusters, predicates as p, spatial, updates
from sightline.registry.base import AS_OF_SQL, S, as_of, joined, km_sql, query, rounded, stamp
from sightline.sources import tables as tb

ACTIVE = "NOT coalesce(is_removed, false)"
PLACED = "lng IS NOT NULL AND lat IS NOT NULL"
SPECIES = "coalesce(nullif(predicted_species,''),'Unknown')"


def cell(c: str, tol: str) -> str:
    return f"CAST(floor({c}/{tol} + 0.5) AS BIGINT)"


@query("hotspots", S(f"""
SELECT cell_lat, cell_lng, round(cell_lat*1e-2,6) AS lat, round(cell_lng*1e-2,6) AS lng, n, species FROM (
 SELECT {cell('lat','1e-2')} AS cell_lat, {cell('lng','1e-2')} AS cell_lng, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT {SPECIES})), '|') AS species
 FROM sightings WHERE {ACTIVE} AND {PLACED} GROUP BY 1,2 HAVING count(*) >= 3)"""))
def hotspots(spark, d):
    h = spatial.hotspots(tb.sightings(spark, d))
    return rounded(h.withColumn("species", joined("species")), "lat", "lng")


@query("top_hotspots", S(f"""
SELECT {cell('lat','1e-2')} AS cell_lat, {cell('lng','1e-2')} AS cell_lng, count(*) AS n
 FROM sightings WHERE {ACTIVE} AND {PLACED} GROUP BY 1,2 HAVING count(*) >= 3 ORDER BY n DESC, cell_lat, cell_lng LIMIT 3"""))
def top_hotspots(spark, d):
    return spatial.top_hotspots(tb.sightings(spark, d)).select("cell_lat", "cell_lng", "n")


@query("density_summary", S(f"""
, cells AS (SELECT {cell('lat','1e-2')} AS a, {cell('lng','1e-2')} AS b, count(*) AS n FROM sightings WHERE {PLACED} GROUP BY 1,2)
SELECT max(n) AS max_density, round(avg(n),6) AS mean_density,
 count(*) FILTER (WHERE n >= 0.7::DOUBLE*(SELECT max(n) FROM cells)) AS dense_cells, count(*) AS cells FROM cells"""))
def density_summary(spark, d):
    return rounded(spatial.density_summary(tb.sightings(spark, d)), "mean_density")


@query("viewport", S(f"""
SELECT round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat, round(min(lng),6) AS min_lng, round(max(lng),6) AS max_lng
 FROM sightings WHERE {PLACED}"""))
def viewport(spark, d):
    return rounded(spatial.viewport(tb.sightings(spark, d)), "min_lat", "max_lat", "min_lng", "max_lng")


PLACES = f", places AS (SELECT lng, lat, count(*)::DOUBLE AS w FROM sightings WHERE {ACTIVE} AND {PLACED} GROUP BY 1,2)"
PAIR_SUM = f"""(SELECT sum(a.w*b.w*{km_sql('a.lng','a.lat','b.lng','b.lat')}) FROM places a, places b
 WHERE a.lat < b.lat OR (a.lat = b.lat AND a.lng < b.lng))"""
PAIR_N = "(SELECT sum(w)*(sum(w)-1)/2 FROM places)"


@query("avg_pair_distance", S(f"""{PLACES}
SELECT round({PAIR_SUM} / {PAIR_N}, 5) AS avg_km, CAST({PAIR_N} AS BIGINT) AS pairs"""))
def avg_pair_distance(spark, d):
    return rounded(spatial.avg_pair_distance(tb.sightings(spark, d)), "avg_km", digits=5)


@query("coverage_stats", S(f"""{PLACES}
, box AS (SELECT min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS e FROM places)
, r AS (SELECT {km_sql('c','a','c','b')}*{km_sql('c','a','e','a')} AS total_area, {PAIR_SUM} / {PAIR_N} AS avg_distance FROM box)
SELECT round(total_area,5) AS total_area, round(avg_distance,5) AS avg_distance,
 CAST(floor(total_area/greatest(avg_distance,1)+0.5) AS BIGINT) AS score FROM r"""))
def coverage_stats(spark, d):
    return rounded(spatial.coverage_stats(tb.sightings(spark, d)), "total_area", "avg_distance", digits=5)


def _diameter_sql(default: str, where: str, out: str) -> str:
    sp = f"coalesce(nullif(predicted_species,''),'{default}')"
    return f""", pts AS (SELECT DISTINCT {sp} AS species, lng, lat FROM sightings WHERE {where} {PLACED})
, spans AS (SELECT a.species, max({km_sql('a.lng','a.lat','b.lng','b.lat')}) AS d FROM pts a JOIN pts b ON a.species = b.species
 AND (a.lat < b.lat OR (a.lat = b.lat AND a.lng <= b.lng)) GROUP BY 1) {out}"""


@query("species_diameter", S(_diameter_sql("Unknown Species", ACTIVE + " AND", "SELECT species, round(d,6) AS diameter_km FROM spans")))
def species_diameter(spark, d):
    return rounded(spatial.species_diameter(tb.sightings(spark, d)), "diameter_km")


@query("species_range_top", S(_diameter_sql("Unknown", "", f"""
, every AS (SELECT DISTINCT {SPECIES} AS species FROM sightings)
SELECT e.species, CASE WHEN length(e.species) > 12 THEN substr(e.species,1,12)||'...' ELSE e.species END AS label,
 CAST(coalesce(floor(d+0.5),0) AS BIGINT) AS range_km,
 CASE WHEN coalesce(floor(d+0.5),0) > 10 THEN 'wide' WHEN coalesce(floor(d+0.5),0) > 5 THEN 'medium' ELSE 'narrow' END AS band
FROM every e LEFT JOIN spans s USING (species) ORDER BY range_km DESC, e.species LIMIT 8""")))
def species_range_top(spark, d):
    return spatial.species_range_top(tb.sightings(spark, d))


@query("species_count_top", S(f"""
SELECT {SPECIES} AS species, CASE WHEN length({SPECIES}) > 12 THEN substr({SPECIES},1,12)||'...' ELSE {SPECIES} END AS label, count(*) AS n
FROM sightings GROUP BY 1,2 ORDER BY n DESC, species LIMIT 8"""))
def species_count_top(spark, d):
    return spatial.species_count_top(tb.sightings(spark, d))


FIRST = f""", r AS (SELECT sighting_id, created_at, {SPECIES} AS species, lng, lat FROM sightings WHERE {ACTIVE} AND {PLACED})
, f AS (SELECT *, first_value(lng) OVER w AS flng, first_value(lat) OVER w AS flat, first_value(sighting_id) OVER w AS fid
 FROM r WINDOW w AS (PARTITION BY species ORDER BY created_at, sighting_id))
, k AS (SELECT sighting_id, species, sighting_id = fid AS is_first, {km_sql('flng','flat','lng','lat')} AS km FROM f)"""


@query("distance_from_first", S(FIRST + " SELECT sighting_id, species, is_first, round(km,6) AS km FROM k"))
def distance_from_first(spark, d):
    return rounded(spatial.distance_from_first(tb.sightings(spark, d)), "km")


@query("spread_patterns", S(FIRST + """
SELECT count(*) FILTER (WHERE m > 5) AS spreading_species FROM (SELECT species, max(km) AS m FROM k GROUP BY 1)"""))
def spread_patterns(spark, d):
    return spatial.spread_patterns(tb.sightings(spark, d))


LEADS = ", ".join(f"lead(sighting_id,{k}) OVER w AS i{k}, lead(lng,{k}) OVER w AS x{k}, lead(lat,{k}) OVER w AS y{k}" for k in range(1, 5))
ROWS = "\nUNION ALL ".join(
    f"SELECT owner, sighting_id, {k} AS step, i{k} AS next_sighting_id, {km_sql('lng','lat',f'x{k}',f'y{k}')} AS km FROM l WHERE i{k} IS NOT NULL"
    for k in range(1, 5))
NEAR = f""", l AS (SELECT owner, sighting_id, lng, lat, {LEADS} FROM sightings WHERE {PLACED}
 WINDOW w AS (PARTITION BY owner ORDER BY created_at DESC, sighting_id)), pairs AS ({ROWS})"""


@query("near_row_pairs", S(NEAR + " SELECT owner, sighting_id, step, next_sighting_id, round(km,6) AS km FROM pairs"))
def near_row_pairs(spark, d):
    return rounded(spatial.near_row_pairs(tb.sightings(spark, d)), "km")


@query("lead_pairs", S(NEAR + " SELECT step, count(*) AS n, round(max(km),6) AS max_km FROM pairs GROUP BY 1"))
def lead_pairs(spark, d):
    pairs = spatial.near_row_pairs(tb.sightings(spark, d))
    return rounded(pairs.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("km").alias("max_km")), "max_km")


@query("distance_histogram", S(NEAR + """
, b AS (SELECT * FROM (VALUES (0,'0-1km'),(1,'1-5km'),(2,'5-10km'),(3,'10-20km'),(4,'20km+')) AS t(bin_no, bin))
, c AS (SELECT CASE WHEN d < 1 THEN 0 WHEN d < 5 THEN 1 WHEN d < 10 THEN 2 WHEN d < 20 THEN 3 ELSE 4 END AS bin_no, count(*) AS n
 FROM (SELECT floor(km+0.5) AS d FROM pairs) GROUP BY 1)
SELECT b.bin_no, bin, coalesce(n,0) AS n FROM b LEFT JOIN c USING (bin_no)"""))
def distance_histogram(spark, d):
    return spatial.distance_histogram(tb.sightings(spark, d))


AGE = f"""CASE WHEN created_at IS NULL OR r <= 0 THEN '#FFD700' WHEN r >= 1 THEN '#FF4444'
 ELSE 'rgb(255, ' || CAST(floor(215-147*r+0.5) AS BIGINT) || ', ' || CAST(greatest(floor(68*(1-r)+0.5),0) AS BIGINT) || ')' END"""
CELLS4 = f""", r0 AS (SELECT *, {cell('lat','1e-4')} AS cell_lat, {cell('lng','1e-4')} AS cell_lng,
 (epoch_us({AS_OF_SQL})-epoch_us(created_at))/86400e6/30 AS r FROM sightings WHERE {PLACED})
, r1 AS (SELECT *, count(*) OVER (PARTITION BY cell_lat, cell_lng) AS n,
 row_number() OVER (PARTITION BY cell_lat, cell_lng ORDER BY created_at DESC, sighting_id) AS rn FROM r0)"""


@query("marker_cells", S(f"""{CELLS4}
SELECT cell_lat, cell_lng, n, sighting_id AS newest_id, round(lat,6) AS lat, round(lng,6) AS lng,
 CASE WHEN n = 1 AND {SPECIES} LIKE '%Unknown%' THEN '#10b981' ELSE {AGE} END AS color FROM r1 WHERE rn = 1"""))
def marker_cells(spark, d):
    return rounded(spatial.marker_cells(tb.sightings(spark, d), as_of()), "lat", "lng")


@query("newest_per_cell", S(f"""{CELLS4}
SELECT cell_lat, cell_lng, n, sighting_id AS newest_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at FROM r1 WHERE rn = 1"""))
def newest_per_cell(spark, d):
    c = spatial.newest_per_cell(tb.sightings(spark, d))
    return c.select("cell_lat", "cell_lng", "n", F.col("newest.sighting_id").alias("newest_id"), stamp("newest.created_at").alias("created_at"))


# the greedy loop itself: each step takes the newest open place and closes what it reaches
LOOP = f"""WITH RECURSIVE pts AS (SELECT lng, lat, count(*) AS n, min(rk) AS rk, min_by(sighting_id, rk) AS id FROM (
 SELECT *, row_number() OVER (ORDER BY created_at DESC, sighting_id) AS rk FROM sightings WHERE {ACTIVE} AND {PLACED}) GROUP BY 1,2),
 step AS (SELECT lng, lat, rk, id, first_value(lng) OVER (ORDER BY rk) AS llng, first_value(lat) OVER (ORDER BY rk) AS llat,
   first_value(id) OVER (ORDER BY rk) AS lid FROM pts
  UNION ALL
  SELECT lng, lat, rk, id, first_value(lng) OVER (ORDER BY rk), first_value(lat) OVER (ORDER BY rk), first_value(id) OVER (ORDER BY rk)
  FROM step WHERE {km_sql('llng','llat','lng','lat')} > 2)
 , leads AS (SELECT DISTINCT lid, llng, llat FROM step)
 , member AS (SELECT s.lng, s.lat, s.lid FROM step s WHERE {km_sql('llng','llat','lng','lat')} <= 2)
 , mem AS (SELECT m.*, p.n FROM member m JOIN pts p USING (lng, lat))"""


@query("leader_clusters", S(LOOP + f"""
, c AS (SELECT lid, sum(n) AS n, sum(lat*n)/sum(n) AS clat, sum(lng*n)/sum(n) AS clng FROM mem GROUP BY 1 HAVING sum(n) >= 2)
, r AS (SELECT lid, max({km_sql('clng','clat','lng','lat')}) AS radius FROM mem JOIN c USING (lid) GROUP BY 1)
, sp AS (SELECT lid, array_to_string(list_sort(list(DISTINCT {SPECIES})),'|') AS species FROM mem JOIN sightings s USING (lng, lat)
  WHERE {ACTIVE} GROUP BY 1)
SELECT lid AS leader_id, CAST(n AS BIGINT) AS n, round(clat,10) AS center_lat, round(clng,10) AS center_lng, round(radius,6) AS radius_km, species
FROM c JOIN r USING (lid) JOIN sp USING (lid)"""))
def leader_clusters(spark, d):
    c = clusters.leader_clusters(tb.sightings(spark, d)).withColumn("species", joined("species"))
    return rounded(rounded(c, "center_lat", "center_lng", digits=10), "radius_km")


@query("cluster_top8", S(LOOP + """
, c AS (SELECT lid AS leader_id, CAST(sum(n) AS BIGINT) AS n FROM mem GROUP BY 1 HAVING sum(n) >= 2)
SELECT leader_id, n, CASE WHEN n > 5 THEN 'large' WHEN n > 3 THEN 'medium' ELSE 'small' END AS band FROM c ORDER BY n DESC, leader_id LIMIT 8"""))
def cluster_top8(spark, d):
    return clusters.cluster_top(tb.sightings(spark, d))


@query("pairs_within_km", S(LOOP + f"""
, q AS (SELECT s.sighting_id, l.lid AS centre_id, {km_sql('l.llng','l.llat','s.lng','s.lat')} AS km
 FROM sightings s, leads l WHERE s.lng IS NOT NULL AND s.lat IS NOT NULL)
SELECT sighting_id, centre_id, round(km,6) AS km FROM q WHERE km <= 2"""))
def pairs_within_km(spark, d):
    s = tb.sightings(spark, d)
    points = spatial.located(s).select("sighting_id", "lng", "lat")
    return rounded(spatial.within_km(points, clusters.cluster_leaders(s)).select("sighting_id", "centre_id", "km"), "km")


@query("bbox_filter", S("""
SELECT sighting_id, round(lng,6) AS lng, round(lat,6) AS lat FROM sightings
WHERE lng BETWEEN 28.05e0 AND 28.15e0 AND lat BETWEEN -25.95e0 AND -25.85e0"""))
def bbox_filter(spark, d):
    s = tb.sightings(spark, d)
    rows = s.where(p.in_bbox(F.col("lng"), F.col("lat"), 28.05, -25.95, 28.15, -25.85))
    return rounded(rows.select("sighting_id", "lng", "lat"), "lng", "lat")


@query("has_location", S(f"SELECT {PLACED} AS placed, count(*) AS n FROM sightings GROUP BY 1"))
def has_location(spark, d):
    s = tb.sightings(spark, d)
    return s.groupBy(p.has_location(F.col("lng"), F.col("lat")).alias("placed")).agg(F.count(F.lit(1)).alias("n"))


@query("haversine_km", S(f"SELECT sighting_id, round({km_sql('28.2395e0','-25.8408e0','lng','lat')},6) AS km FROM sightings WHERE {PLACED}"))
def haversine(spark, d):
    s = spatial.located(tb.sightings(spark, d))
    km = haversine_km(F.lit(28.2395), F.lit(-25.8408), F.col("lng"), F.col("lat"))
    return rounded(s.select("sighting_id", km.alias("km")), "km")


@query("grid_cell", S(f"SELECT {cell('lat','1e-2')} AS cell_lat, {cell('lng','1e-2')} AS cell_lng, count(*) AS n FROM sightings WHERE {PLACED} GROUP BY 1,2"))
def grid_cells(spark, d):
    s = spatial.located(tb.sightings(spark, d))
    return s.groupBy(grid_cell(F.col("lat"), 0.01).alias("cell_lat"), grid_cell(F.col("lng"), 0.01).alias("cell_lng")).agg(
        F.count(F.lit(1)).alias("n"))


@query("format_latlng", S("""
SELECT sighting_id, CASE WHEN lng IS NULL THEN '' ELSE printf('%.4f, %.4f', floor(lat*1e4+0.5)/1e4, floor(lng*1e4+0.5)/1e4) END AS place FROM sightings"""))
def latlng_text(spark, d):
    return tb.sightings(spark, d).select("sighting_id", format_latlng(F.col("lng"), F.col("lat")).alias("place"))


# codes: signup events register the user's code, purchase events use it
CODES = """, e AS (SELECT sighting_id, owner, created_at, predicted_species AS k FROM sightings)
, j AS (SELECT u.sighting_id AS use_id, u.owner AS code, max(r.created_at) AS reg, u.created_at AS used
 FROM e u JOIN e r ON r.owner = u.owner AND r.k = 'Unknown species' AND r.created_at <= u.created_at
  AND u.created_at < r.created_at + INTERVAL 24 HOUR WHERE u.k = 'Bidens_pilosa' GROUP BY 1,2,4)"""


def _codes(spark, d):
    s = tb.sightings(spark, d)
    regs = s.where(F.col("predicted_species") == "Unknown species").select(F.col("owner").alias("code"), F.col("created_at").alias("ts"))
    uses = s.where(F.col("predicted_species") == "Bidens_pilosa").select(
        F.col("sighting_id").alias("use_id"), F.col("owner").alias("code"), F.col("created_at").alias("ts"))
    return regs, uses


@query("code_session_join", S(CODES + """
SELECT use_id, code, strftime(reg,'%Y-%m-%d %H:%M:%S') AS registered_at, strftime(used,'%Y-%m-%d %H:%M:%S') AS used_at FROM j"""))
def code_session_join(spark, d):
    out = updates.code_session_join(*_codes(spark, d))
    return out.withColumns({"registered_at": stamp("registered_at"), "used_at": stamp("used_at")})
