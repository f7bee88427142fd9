"""Queries of dataset curation, training tables and classifier outputs."""

import re

from pyspark.sql import functions as F

from sightline.functions import arrays as ar
from sightline.operators import curation as c, scoring, vectors
from sightline.operators.predicates import filter_cc0
from sightline.plans import manifests
from sightline.registry.base import over, query, rounded
from sightline.session import new_path
from sightline.sources import readers, tables as tb, writers

OBS = over(obs=tb.OBSERVATIONS)
TAX = over(photos=tb.PHOTOS, obs_taxa=tb.OBS_TAXA, taxa=tb.TAXA)
INV = over(inv=tb.INVENTORY)

CLEAN = r"regexp_replace(translate({x}, ' /\', '___'), '[^a-zA-Z0-9_]', '', 'g')"
OBS_SPECIES = CLEAN.format(x="coalesce(scientific_name, common_name, 'Unknown_Species_' || coalesce(iconic_taxon_name,'unnamed'))")
PHOTO_ID = r"""coalesce(nullif(regexp_extract(image_url,'inaturalist-open-data\.s3\.amazonaws\.com/photos/(\d+)/',1),''),
 nullif(regexp_extract(image_url,'static\.inaturalist\.org/photos/(\d+)/',1),''), CASE WHEN regexp_matches(id,'^[0-9]+$') THEN id END)"""
OPEN = "'https://inaturalist-open-data.s3.amazonaws.com/photos/' || {p} || '/medium.jpg'"
STATIC = "'https://static.inaturalist.org/photos/' || {p} || '/medium.jpg'"
URL = r"CASE WHEN regexp_matches(lower(image_url),'\.(jpg|jpeg|png)$') THEN image_url ELSE " + OPEN.format(p="photo_id") + " END"


def parsed(spark, d):
    """Observations with an address, a species and a photo id."""
    return c.with_photo_id(c.with_clean_species(tb.observations(spark, d).dropna(subset=["id", "image_url"])))


PARSED = f", parsed AS (SELECT * FROM (SELECT *, {OBS_SPECIES} AS species, {PHOTO_ID} AS photo_id FROM obs WHERE id IS NOT NULL AND image_url IS NOT NULL) WHERE photo_id IS NOT NULL)"


@query("src_photos_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def src_photos_parquet(spark, d):
    return readers.read_photos(spark, f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("filter_cc0", TAX("SELECT photo_id, observation_id FROM photos WHERE upper(license) LIKE '%CC0%'"))
def filter_cc0_query(spark, d):
    return tb.photos(spark, d).where(filter_cc0(F.col("license"))).select("photo_id", "observation_id")


@query("clean_species", OBS(f"SELECT id, {OBS_SPECIES} AS species FROM obs"))
def clean_species(spark, d):
    return c.with_clean_species(tb.observations(spark, d)).select("id", "species")


@query("photo_id", OBS(f"{PARSED} SELECT id, photo_id FROM parsed"))
def photo_id(spark, d):
    return parsed(spark, d).select("id", "photo_id")


@query("download_url", OBS(f"{PARSED} SELECT id, {URL} AS url FROM parsed"))
def download_url(spark, d):
    return parsed(spark, d).select("id", c.download_url(F.col("image_url"), F.col("photo_id")).alias("url"))


@query("candidate_urls", OBS(f"""{PARSED}
SELECT id, image_url || CASE WHEN image_url <> {OPEN.format(p='photo_id')} THEN '|' || {OPEN.format(p='photo_id')} ELSE '' END
 || '|' || {STATIC.format(p='photo_id')} AS urls FROM parsed"""))
def candidate_urls(spark, d):
    return parsed(spark, d).select("id", F.array_join(c.candidate_urls(F.col("image_url"), F.col("photo_id")), "|").alias("urls"))


TAXED = f""", named AS (SELECT o.observation_uuid, o.taxon_id, t.name, {CLEAN.format(x='t.name')} AS species FROM obs_taxa o JOIN taxa t USING (taxon_id))
, cc AS (SELECT photo_id, observation_id FROM photos WHERE upper(license) LIKE '%CC0%')
, ps AS (SELECT photo_id, observation_id, species FROM cc JOIN named ON observation_id = observation_uuid)"""


@query("join_obs_taxa", TAX(f"{TAXED} SELECT observation_uuid, taxon_id, name, species FROM named"))
def join_obs_taxa(spark, d):
    return c.join_obs_taxa(tb.obs_taxa(spark, d), tb.taxa(spark, d))


def photo_species(spark, d):
    return c.join_photo_species(c.licensed_photos(tb.photos(spark, d)), c.join_obs_taxa(tb.obs_taxa(spark, d), tb.taxa(spark, d)))


@query("join_photo_species", TAX(f"{TAXED} SELECT * FROM ps"))
def join_photo_species(spark, d):
    return photo_species(spark, d)


def sampled_sql(source: str, by: str, id_: str, k: int, min_n: int) -> str:
    return f"""SELECT * EXCLUDE (rn, cnt) FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS cnt,
 row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || {id_}), {id_}) AS rn FROM {source}) WHERE rn <= {k} AND cnt >= {min_n}"""


@query("photos_per_species", TAX(f"{TAXED} {sampled_sql('ps', 'species', 'photo_id', 25, 20)}"))
def photos_per_species(spark, d):
    return c.photos_per_species(photo_species(spark, d), 20, 25)


@query("sample_per_species", TAX(f"{TAXED} {sampled_sql('ps', 'species', 'photo_id', 20, 0)}"))
def sample_per_species(spark, d):
    return c.sample_per_group(photo_species(spark, d), "species", "photo_id", 20)


@query("photos_per_observation", TAX(f"""{TAXED}
, o AS (SELECT DISTINCT observation_id FROM cc), pick AS (SELECT observation_id FROM o ORDER BY md5('42|' || observation_id), observation_id LIMIT 20)
SELECT {OPEN.format(p='photo_id')} AS url, 'observation_' || observation_id || '/' || photo_id || '.jpg' AS path, photo_id, observation_id
FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY photo_id) AS rn FROM cc SEMI JOIN pick USING (observation_id)) WHERE rn <= 20"""))
def photos_per_observation(spark, d):
    return c.photos_per_observation(c.licensed_photos(tb.photos(spark, d)))


def _manifest(spark, d, **kw):
    return manifests.build_manifest(tb.observations(spark, d), _on_disk(spark, d), **kw)


def _on_disk(spark, d):
    """Paths already fetched: every thirteenth observation or order, under its own species."""
    obs = c.with_clean_species(tb.observations(spark, d)).where("CAST(id AS BIGINT) % 13 = 0")
    return obs.select(F.concat("species", F.lit("/"), "species", F.lit("_"), "id", F.lit(".jpg")).alias("path"))


DISK = f", disk AS (SELECT species || '/' || species || '_' || id || '.jpg' AS path FROM (SELECT id, {OBS_SPECIES} AS species FROM obs) WHERE CAST(id AS BIGINT) % 13 = 0)"


@query("build_manifest", OBS(f"""{PARSED}{DISK}
, smp AS ({sampled_sql('parsed', 'species', 'id', 20, 2)})
SELECT * FROM (SELECT {URL} AS url, species || '/' || species || '_' || id || '.jpg' AS path, id AS observation_id, photo_id, species FROM smp)
 WHERE path NOT IN (SELECT path FROM disk)"""))
def build_manifest(spark, d):
    return _manifest(spark, d, min_n=2, max_n=20)


@query("manifest_pending", OBS(f"""{PARSED}{DISK}
, m AS (SELECT id, species || '/' || species || '_' || id || '.jpg' AS path FROM parsed) SELECT id, path FROM m WHERE path NOT IN (SELECT path FROM disk)"""))
def manifest_pending(spark, d):
    m = parsed(spark, d).select("id", F.concat("species", F.lit("/"), "species", F.lit("_"), "id", F.lit(".jpg")).alias("path"))
    return c.manifest_pending(m, _on_disk(spark, d))


def _photo_disk(spark, d):
    done = photo_species(spark, d).where("photo_id % 13 = 0")
    return done.select(F.concat("species", F.lit("/"), "species", F.lit("_"), F.col("observation_id").cast("string"), F.lit(".jpg")).alias("path"))


@query("build_manifest_taxa", TAX(f"""{TAXED}
, smp AS ({sampled_sql('ps', 'species', 'photo_id', 250, 10)})
, t AS (SELECT {OPEN.format(p='photo_id')} AS url, species || '/' || species || '_' || observation_id || '.jpg' AS path, photo_id, observation_id, species FROM smp)
SELECT * FROM t WHERE path NOT IN (SELECT species || '/' || species || '_' || observation_id || '.jpg' FROM ps WHERE photo_id % 13 = 0)"""))
def build_manifest_taxa(spark, d):
    return manifests.build_manifest_taxa(
        c.licensed_photos(tb.photos(spark, d)), tb.obs_taxa(spark, d), tb.taxa(spark, d), _photo_disk(spark, d))


@query("resume_remaining", INV("SELECT path, class_name FROM inv WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def resume_remaining(spark, d):
    done = tb.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    return c.remaining(tb.inventory(spark, d), done, "order_id").select("path", "class_name")


@query("union_chunks", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F','O','P') GROUP BY 1")
def union_chunks(spark, d):
    orders = tb.table(spark, d, "orders")
    parts = [orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderstatus").alias("status")) for s in "FOP"]
    return c.union_chunks(*parts).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("cap_per_class", INV(sampled_sql("inv", "class_name", "path", 37, 0)))
def cap_per_class(spark, d):
    return c.cap_per_class(tb.inventory(spark, d))


@query("batch_number", INV("SELECT path, class_name, CAST(floor((row_number() OVER (PARTITION BY class_name ORDER BY path)-1)/300.0) AS BIGINT) AS batch FROM inv"))
def batch_number(spark, d):
    return c.batch_number(tb.inventory(spark, d), "class_name", "path", 300).select("path", "class_name", "batch")


@query("file_counter", INV("SELECT path, row_number() OVER (PARTITION BY class_name ORDER BY path)-1 AS counter FROM inv"))
def file_counter(spark, d):
    return c.file_counter(tb.inventory(spark, d)).select("path", "counter")


@query("class_index", INV("SELECT path, dense_rank() OVER (ORDER BY class_name)-1 AS label FROM inv"))
def class_index(spark, d):
    return c.class_index(tb.inventory(spark, d)).select("path", "label")


AUDIT = """, n AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'observation_' ELSE 'Species_' END || l_orderkey AS class_name, count(*) AS n FROM lineitem GROUP BY 1)
, q AS (SELECT *, row_number() OVER (ORDER BY n, class_name) - 1 AS r, count(*) OVER () AS k FROM n)"""


def _classes(spark, d):
    """One folder per order, some of them observation folders; lines are images."""
    lines = tb.table(spark, d, "lineitem")
    name = F.concat(F.when(F.col("l_orderkey") % 9 == 0, "observation_").otherwise("Species_"), F.col("l_orderkey").cast("string"))
    return c.class_counts(lines.select(name.alias("class_name")))


@query("dataset_audit", INV(f"""{AUDIT}
SELECT CAST(sum(n) AS BIGINT) AS images, count(*) AS folders, count(*) FILTER (WHERE class_name LIKE 'observation\\_%' ESCAPE '\\') AS observation_folders,
 count(*) FILTER (WHERE class_name NOT LIKE 'observation\\_%' ESCAPE '\\') AS species_folders, round(avg(n),6) AS avg_size,
 max(CASE WHEN r = CAST(floor(k/2.0) AS BIGINT) THEN n END) AS median_size, min(n) AS min_size, max(n) AS max_size,
 count(*) FILTER (WHERE n > 0 AND n < 10) AS small, count(*) FILTER (WHERE n > 200) AS large FROM q"""))
def dataset_audit(spark, d):
    return rounded(c.dataset_audit(_classes(spark, d)), "avg_size")


@query("audit_advice", INV(f"""{AUDIT}
, a AS (SELECT sum(n) AS images, count(*) AS f, count(*) FILTER (WHERE class_name NOT LIKE 'observation%') AS s, count(*) FILTER (WHERE n > 0 AND n < 10) AS sm,
 count(*) FILTER (WHERE n > 200) AS lg FROM n)
SELECT * FROM (SELECT 1 AS advice_no, 'Your dataset is organized by observation ID rather than species.' AS advice FROM a WHERE f - s > 0 AND s = 0
UNION ALL SELECT 2, 'Your dataset has many species with too few images.' FROM a WHERE s > 0 AND sm > 0.3*f
UNION ALL SELECT 3, 'Your dataset has some species with very many images.' FROM a WHERE s > 0 AND lg > 0.1*f
UNION ALL SELECT 4, 'Your dataset may be too small for robust training.' FROM a WHERE images < 5000)"""))
def audit_advice(spark, d):
    return c.audit_advice(c.dataset_audit(_classes(spark, d)))


@query("below_min_classes", INV(f"{AUDIT} SELECT class_name, n FROM n WHERE n < 5 AND class_name NOT LIKE 'observation%'"))
def below_min_classes(spark, d):
    return c.below_min_classes(_classes(spark, d), 5)


# ---- fetching with a stand-in for the network ----------------------------------------------


def stand_in(url: str) -> tuple[int, bytes | None]:
    """Answers by the last digit of the photo id: 0 is busy, 1 is missing, 2 breaks on the first host."""
    m = re.search(r"(\d)/medium\.jpg$", url)
    if m is None:
        return 404, None
    digit, static = m.group(1), "static" in url
    if digit == "0":
        return 503, None
    if digit == "1":
        return 404, None
    if digit == "2" and not static:
        raise ConnectionError("reset")
    return 200, b"image"


def outcomes(spark, d):
    tasks = parsed(spark, d).select(
        F.concat("species", F.lit("_"), "id").alias("path"), "species", c.candidate_urls(F.col("image_url"), F.col("photo_id")).alias("urls"))
    return c.fetch_outcomes(tasks, stand_in)


OUTCOME = f"""{PARSED}, oc AS (SELECT species || '_' || id AS path, species, right(photo_id,1) NOT IN ('0','1') AS ok,
 CASE right(photo_id,1) WHEN '0' THEN 'HTTP 503' WHEN '1' THEN 'HTTP 404' END AS error FROM parsed)"""


@query("fetch_outcomes", OBS(f"{OUTCOME} SELECT path, species, ok, error FROM oc"))
def fetch_outcomes(spark, d):
    return outcomes(spark, d)


@query("fetch_stats", OBS(f"""{OUTCOME} SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed,
 round(count(*) FILTER (WHERE ok)/count(*)::DOUBLE*100,6) AS success_pct, round(count(*) FILTER (WHERE NOT ok)/count(*)::DOUBLE*100,6) AS failed_pct FROM oc"""))
def fetch_stats(spark, d):
    return rounded(c.fetch_stats(outcomes(spark, d)), "success_pct", "failed_pct")


@query("fetch_errors", OBS(f"{OUTCOME} SELECT error, count(*) AS n FROM oc WHERE NOT ok GROUP BY 1 ORDER BY n DESC, error LIMIT 5"))
def fetch_errors(spark, d):
    return c.fetch_errors(outcomes(spark, d))


@query("fetch_weak_classes", OBS(f"""{OUTCOME} SELECT species, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed FROM oc GROUP BY 1
 HAVING count(*) FILTER (WHERE NOT ok) > 0.1*count(*) FILTER (WHERE ok)"""))
def fetch_weak_classes(spark, d):
    return c.fetch_weak_classes(outcomes(spark, d))


# ---- training table ------------------------------------------------------------------------


def _share_sql(*parts: str) -> str:
    return "CAST(('0x' || substr(md5('42|' || " + " || '|' || ".join(parts) + "),1,8)) AS BIGINT)/4294967296.0::DOUBLE"


@query("training_table", INV(f"""
, r AS (SELECT path, class_name, dense_rank() OVER (ORDER BY class_name)-1 AS label, unnest(range(10)) AS aug FROM inv)
SELECT path, class_name, label, CAST(aug AS INTEGER) AS aug,
 CASE WHEN aug = 0 OR {_share_sql("'m'", 'path', 'aug')} < 0.6 THEN 'realistic' ELSE 'seasonal' END AS method,
 CASE WHEN {_share_sql("'s'", 'path')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM r"""))
def training_table(spark, d):
    return manifests.training_table(tb.inventory(spark, d))


# ---- vectors and scores --------------------------------------------------------------------

CLASSES = 64
LOGITS = "list_transform(embedding, lambda x: x::DOUBLE)"


def scored(spark, d):
    """Vectors as classifier outputs: their numbers are logits of so many classes, the label is the truth."""
    e = tb.table(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 5).alias("epoch"), F.col("embedding").cast("array<double>").alias("logits"))


SCORED = f"WITH sc AS (SELECT vec_id, label, vec_id % 5 AS epoch, {LOGITS} AS x FROM embeddings), sx AS (SELECT *, list_max(x) AS m, list_sum(list_transform(x, lambda v: exp(v-list_max(x)))) AS z FROM sc)"


@query("softmax", f"{SCORED} SELECT vec_id, CAST(i AS INTEGER) AS i, round(exp(x[i+1]-m)/z,6) AS p FROM sx, range({CLASSES}) AS r(i)")
def softmax(spark, d):
    return rounded(scored(spark, d).select("vec_id", F.posexplode(ar.softmax(F.col("logits"))).alias("i", "p")), "p")


@query("argmax", f"{SCORED} SELECT vec_id, CAST(list_position(x, m)-1 AS INTEGER) AS predicted, round(1/z,6) AS confidence FROM sx")
def argmax(spark, d):
    return rounded(scoring.with_prediction(scored(spark, d)).select("vec_id", "predicted", "confidence"), "confidence")


@query("top_predictions", f"""{SCORED}
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x[i+1] DESC, i)-1 AS INTEGER) AS rank, 'class_' || i AS name, round(exp(x[i+1]-m)/z,6) AS confidence
FROM sx, range({CLASSES}) AS r(i) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x[i+1] DESC, i) <= 5""")
def top_predictions(spark, d):
    names = F.array(*[F.lit(f"class_{i}") for i in range(CLASSES)])
    top = scoring.top_predictions(scored(spark, d), names, 5).select("vec_id", F.posexplode("top").alias("rank", "t"))
    return rounded(top.select("vec_id", "rank", "t.name", F.col("t.confidence").alias("confidence")), "confidence")


@query("classification_metrics", f"""{SCORED}
, g AS (SELECT epoch, count(*) AS n, avg(CASE WHEN list_position(x,m)-1 = label THEN 1.0::DOUBLE ELSE 0 END)*100 AS accuracy, avg(ln(z)+m-x[label+1]) AS loss FROM sx GROUP BY 1)
SELECT epoch, n, round(accuracy,6) AS accuracy, round(loss,6) AS loss, epoch = (SELECT epoch FROM g ORDER BY accuracy DESC, epoch LIMIT 1) AS best FROM g""")
def classification_metrics(spark, d):
    return rounded(scoring.classification_metrics(scored(spark, d)), "accuracy", "loss")


@query("normalize_channels", f"""WITH sc AS (SELECT vec_id, {LOGITS} AS x FROM embeddings), px AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM sc)
SELECT vec_id, CAST(i AS INTEGER) AS i, round((v - CASE i % 3 WHEN 0 THEN 0.485::DOUBLE WHEN 1 THEN 0.456 ELSE 0.406 END) / CASE i % 3 WHEN 0 THEN 0.229::DOUBLE WHEN 1 THEN 0.224 ELSE 0.225 END, 6) AS normal,
 round(v, 6) AS back FROM px""")
def normalize_channels(spark, d):
    normal = scored(spark, d).select("vec_id", ar.normalize_channels(F.col("logits")).alias("v"))
    both = normal.select("vec_id", F.posexplode(F.arrays_zip(F.col("v").alias("normal"), ar.denormalize_channels(F.col("v")).alias("back"))).alias("i", "x"))
    return rounded(both.select("vec_id", "i", "x.*"), "normal", "back")


CENTROIDS = """, pos AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1,65) AS r(i) GROUP BY 1,2)
, cen AS (SELECT CAST(label AS BIGINT) AS id, list(m ORDER BY i) AS c FROM pos GROUP BY 1)"""


def centroids(spark, d):
    """Mean vector of each label: one row per class."""
    e = tb.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("long").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("embedding"))


DIST = "list_sum(list_transform(list_zip({a},{b}), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE)))"


@query("knn", f"""WITH one AS (SELECT 1){CENTROIDS}
, x AS (SELECT id AS query_id, vec_id, {DIST.format(a='c', b='embedding')} AS dist FROM cen, embeddings)
SELECT query_id, vec_id, round(dist,6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x) WHERE rank <= 5""")
def knn(spark, d):
    queries = centroids(spark, d).withColumnRenamed("id", "query_id")
    return rounded(vectors.knn(queries, tb.table(spark, d, "embeddings"), k=5), "distance")


@query("knn_topk", f"""WITH one AS (SELECT 1){CENTROIDS}
, x AS (SELECT vec_id AS query_id, id AS vec_id, {DIST.format(a='c', b='embedding')} AS dist FROM cen, embeddings)
SELECT query_id, vec_id, round(dist,6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x) WHERE rank <= 3""")
def knn_topk(spark, d):
    queries = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.knn_topk(centroids(spark, d).withColumnRenamed("id", "vec_id"), queries, 3), "distance")


# ---- files: written to the shared folder by the job, then read back -------------------------


@query("sink_parquet", TAX(f"{TAXED} SELECT observation_id % 10 AS k, count(*) AS n FROM cc GROUP BY 1"))
def sink_parquet(spark, d):
    path = new_path(spark, "photos")
    writers.write_photos(c.licensed_photos(tb.photos(spark, d)), path)
    return readers.read_photos(spark, path).groupBy((F.col("observation_id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("src_photo_tsv", TAX("SELECT license, count(*) AS n FROM photos GROUP BY 1"))
def src_photo_tsv(spark, d):
    path = new_path(spark, "photo-tsv")
    raw = tb.photos(spark, d).select("photo_id", F.col("observation_id").alias("observation_uuid_id"), F.col("license").alias("License_code"))
    raw.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_photo_metadata(spark, path).groupBy("license").agg(F.count(F.lit(1)).alias("n"))


@query("src_observations", OBS("SELECT id, image_url, scientific_name FROM obs WHERE id IS NOT NULL AND image_url IS NOT NULL"))
def src_observations(spark, d):
    path = new_path(spark, "observations")
    tb.observations(spark, d).write.option("header", True).csv(path)
    return readers.read_observations(spark, path).select("id", "image_url", "scientific_name")


@query("src_taxa", TAX("SELECT t.name, count(*) AS n FROM obs_taxa o JOIN taxa t USING (taxon_id) GROUP BY 1"))
def src_taxa(spark, d):
    a, b = new_path(spark, "taxa"), new_path(spark, "obs-taxa")
    tb.taxa(spark, d).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(a)
    tb.obs_taxa(spark, d).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(b)
    joined_ = c.join_obs_taxa(readers.read_obs_taxa(spark, b), readers.read_taxa(spark, a))
    return joined_.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("column_audit", OBS("""SELECT CAST(column_index AS INTEGER) AS position, column_name AS "column",
 regexp_matches(lower(column_name),'kingdom|phylum|class|order|family|genus|taxon|taxonomy') AS taxonomic
FROM (SELECT row_number() OVER ()-1 AS column_index, column_name FROM (DESCRIBE SELECT * FROM orders))"""))
def column_audit(spark, d):
    return readers.column_audit(tb.table(spark, d, "orders"))
