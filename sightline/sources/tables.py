"""Views that give the star-schema and event tables the shapes this library works on.

Each view is one SELECT that Spark and DuckDB both run, so the batch query and its check read
the same rows. ``{name}`` stands for the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.session import spread

AS_OF = "2024-01-30 12:00:00"

SIGHTINGS = """
SELECT event_id AS sighting_id, user_id AS owner,
 CASE WHEN event_id % 5 <> 0 THEN CONCAT('/uploads/', CAST(event_id AS STRING), '.jpg') END AS image_path,
 event_id % 4 = 0 AS from_video,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE 28e0 + (event_id*37 % 101)*3e-3 END AS lng,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE -26e0 + (event_id*61 % 89)*3e-3 END AS lat,
 CASE event_type WHEN 'click' THEN 'Acacia_mearnsii' WHEN 'view' THEN 'Lantana_camara'
                 WHEN 'purchase' THEN 'Bidens_pilosa' WHEN 'signup' THEN 'Unknown species' ELSE NULL END AS predicted_species,
 LEAST(value/2e2, 1e0) AS confidence,
 CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS llm_status,
 CASE WHEN value >= 100 THEN 'High' WHEN value >= 40 THEN 'Medium' WHEN value >= 10 THEN 'Low' ELSE NULL END AS risk_level,
 CAST(ts AS TIMESTAMP) AS created_at,
 CAST(ts - INTERVAL '1' HOUR AS TIMESTAMP) AS captured_at,
 event_id % 11 = 0 AS is_removed,
 CASE WHEN event_id % 11 = 0 THEN CAST(ts + INTERVAL '1' DAY AS TIMESTAMP) END AS removed_at,
 CASE WHEN event_id % 11 = 0 THEN 'user' END AS removed_by
FROM {events}
"""

OBSERVATIONS = """
SELECT CAST(p_partkey AS STRING) AS id,
  CASE p_partkey % 4 WHEN 0 THEN CONCAT('https://inaturalist-open-data.s3.amazonaws.com/photos/', CAST(p_partkey*7 AS STRING), '/medium.jpg')
                     WHEN 1 THEN CONCAT('https://static.inaturalist.org/photos/', CAST(p_partkey*7 AS STRING), '/medium')
                     WHEN 2 THEN CONCAT('https://example.org/', CAST(p_partkey AS STRING)) ELSE NULL END AS image_url,
  CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS scientific_name,
  CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS common_name,
  CASE WHEN p_partkey % 10 <> 0 THEN 'Plantae' END AS iconic_taxon_name
FROM {part}
"""

TAXA = "SELECT CAST(n_nationkey AS BIGINT) AS taxon_id, n_name AS name FROM {nation}"

OBS_TAXA = """
SELECT c_custkey AS observation_uuid, CAST(CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS BIGINT) AS taxon_id
FROM {customer}
"""

PHOTOS = """
SELECT o_orderkey AS photo_id, o_custkey AS observation_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'CC0' WHEN 1 THEN 'CC-BY' ELSE 'cc0-1.0' END AS license
FROM {orders}
"""

#: Images on disk: one row per order line, the part brand as the class folder.
INVENTORY = """
SELECT CONCAT(REPLACE(p_brand, '#', '_'), '/', REPLACE(p_brand, '#', '_'), '_', CAST(l_orderkey AS STRING), '_',
              CAST(l_linenumber AS STRING), '.jpg') AS path,
       REPLACE(p_brand, '#', '_') AS class_name, l_orderkey AS order_id, l_quantity AS size_kb
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Field-guide pages: every document's whole text under a species header, four pages to a species.
FIELD_PAGES = """
SELECT doc_id AS page_no, CONCAT(
  CASE WHEN doc_id % 5 = 0 THEN CONCAT('Left column.', CHR(10), '<<COLBREAK>>', CHR(10)) ELSE CONCAT('ND', CHR(10)) END,
  CASE CAST(FLOOR(doc_id / 4e0) AS BIGINT) % 7 WHEN 0 THEN 'Acacia' WHEN 1 THEN 'Lantana' WHEN 2 THEN 'Bidens' WHEN 3 THEN 'Solanum'
                  WHEN 4 THEN 'Pinus' WHEN 5 THEN 'Salvia' ELSE 'Rubus' END, ' ',
  CASE WHEN doc_id % 29 = 0 THEN 'Nomen'
       ELSE CONCAT('spec', TRANSLATE(CAST(CAST(FLOOR(doc_id / 4e0) AS BIGINT) AS STRING), '0123456789', 'abcdefghij')) END,
  CASE WHEN doc_id % 3 = 0 THEN ' (cont.)' WHEN doc_id % 3 = 1 THEN ' 1b' ELSE '' END, CHR(10), CHR(10),
  CASE WHEN doc_id % 13 = 0 THEN 'Order' ELSE 'Family' END, ': ',
  CASE doc_id % 4 WHEN 0 THEN 'Fabaceae' WHEN 1 THEN 'Rosaceae' WHEN 2 THEN 'Asteraceae' ELSE 'Pinaceae' END, CHR(10),
  'Common names: ', source, ' weed, ', lang, '-bush / Weed ', source, CHR(10), 'Herb', CHR(10), CHR(10),
  'Origin: ', lang, ' - ', source, ' (1)', CHR(10), 'Soft stems.', CHR(10), CHR(10),
  'Where found?', CHR(10), 'Near ', source, ' (3)', CHR(10), 'and dams.', CHR(10),
  '<<COLBREAK>>', CHR(10), '(9)', CHR(10),
  CASE WHEN doc_id % 2 = 0 THEN CONCAT('Sap of ', source, ' is toxic to goats. Flowers red.') ELSE 'Flowers white.' END, CHR(10), CHR(10),
  'Not to be confused with', CHR(10), lang, CHR(10), 'taller kinds.', CHR(10), CHR(10),
  'Treatment', CHR(10), CASE doc_id % 6 WHEN 0 THEN 'Eradicate on sight. ' WHEN 1 THEN 'Control by hand. ' WHEN 2 THEN 'Needs a permit. '
                                         WHEN 3 THEN 'Keep in gardens. ' ELSE '' END, text) AS text
FROM {documents}
"""

#: Text blocks: every line of every document is a block placed on a page of 600 by 800.
BLOCKS = """
SELECT page_no, 6e2 AS page_width, 8e2 AS page_height,
  CAST(CASE WHEN block_no % 2 = 0 THEN 40 + (page_no * 7 + block_no) % 9 ELSE 320 + (page_no * 5 + block_no) % 9 END AS DOUBLE) AS x0,
  CAST(block_no * 3 AS DOUBLE) AS y0,
  CAST(CASE WHEN block_no % 2 = 0 THEN 260 ELSE 560 END AS DOUBLE) AS x1,
  CAST(block_no * 3 + 2 AS DOUBLE) AS y1,
  line AS text, CAST(block_no AS INT) AS block_no, CAST(CASE WHEN block_no % 19 = 18 THEN 1 ELSE 0 END AS INT) AS block_type
FROM {doc_lines}
"""

#: Knowledge base literals; each lookup joins them to a whole table.
KNOWLEDGE = """
SELECT * FROM (VALUES
 ('Acacia mearnsii', 'Alpha tree', 'Fabaceae', 'Eradicate on sight', 'Not found', 'Dark bark.', 'Near rivers'),
 ('Acacia dealbata', 'Beta tree', 'Fabaceae', 'Cut and paint stumps', 'Not found', 'Silver leaves.', 'Hills'),
 ('Lantana camara', 'Gamma shrub', 'Verbenaceae', 'Needs a permit', 'Not found', 'Rough stems.', 'Road sides'),
 ('Ornus hortus', 'Delta', 'Rosaceae', 'Keep inside gardens', 'Not found', 'Not found', 'Not found'),
 ('Bidens pilosa', 'Epsilon', 'Asteraceae', 'Not found', 'Not found', 'Not found', 'Fields 12'),
 ('Nullus planus', 'Not found', 'Rosaceae', 'Not found', 'Not found', 'Not found', 'Not found'),
 ('Toxus malus', 'Zeta', 'Rosaceae', 'Not found', 'Toxic sap.', 'Not found', 'Not found')
) AS t(scientific_name, common_names, family, treatment, poisonous, description, where_found)
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Tables whose rows cost much work each.
HEAVY = {"documents", "embeddings", "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in HEAVY else scan


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text over the tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used) if used else spark.sql(sql)


def duck(sql: str) -> str:
    """The same view text for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("AS STRING", "AS VARCHAR")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGHTINGS)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBSERVATIONS)


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TAXA)


def obs_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBS_TAXA)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PHOTOS)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INVENTORY)


def field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FIELD_PAGES)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_lines = docs.selectExpr("doc_id AS page_no", "posexplode(split(text, '\n')) AS (block_no, line)")
    return spark.sql(BLOCKS, doc_lines=doc_lines)


def duck_blocks() -> str:
    doc_lines = (
        "(SELECT doc_id AS page_no, UNNEST(string_split(text, chr(10))) AS line, "
        "UNNEST(range(len(string_split(text, chr(10))))) AS block_no FROM documents)"
    )
    return BLOCKS.replace("{doc_lines}", doc_lines)


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.sql(KNOWLEDGE)
