"""Scans of every input the library knows. All are lazy and split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import schemas
from sightline.functions.text import strip

AUDIT_KEYWORDS = ["kingdom", "phylum", "class", "order", "family", "genus", "taxon", "taxonomy"]


def _pick(columns: list[str], what: str, test) -> str:
    for c in columns:
        if test(c.lower()):
            return c
    raise ValueError(f"no {what} column among {columns}")


def read_photo_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated photo table; the licence, photo and observation columns are found by name.

    Rows too short to hold the three columns are dropped.
    """
    header = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = header.columns
    picked = {
        "license": _pick(names, "license", lambda c: "license" in c),
        "photo_id": _pick(names, "photo id", lambda c: c in ("id", "photo_id")),
        "observation_id": _pick(names, "observation id", lambda c: "observation" in c and "id" in c),
    }
    needed = max(names.index(c) for c in picked.values())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # read whole lines: a short row is known by its number of separators
    lines = spark.read.text(path).where(F.size(F.split(strip(F.col("value")), "\t")) > needed).select(F.split(strip(F.col("value")), "\t").alias("f"))
    row = lines.select(*[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(schema.names)])
    return row.select(*[F.col(f"`{c}`").alias(k) for k, c in picked.items()]).where(F.col("license") != F.lit(picked["license"]))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation CSV; rows without an id or an image address are dropped."""
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    names = [f.name for f in schemas.OBSERVATION]
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return rows.select(*names).dropna(subset=["id", "image_url"])


def _read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    missing = [n for n in required if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return rows.select(*required)


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, ["taxon_id", "name"])


def read_obs_taxa(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, ["observation_uuid", "taxon_id"])


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """Class list: one name per line, blanks dropped, index by line order."""
    whole = spark.read.text(path, wholetext=True)
    names = F.filter(F.transform(F.split("value", r"\r?\n"), lambda n: F.trim(n)), lambda n: n != "")
    return whole.select(F.posexplode(names).alias("class_index", "class_name"))


def read_page_texts(spark: SparkSession, glob: str) -> DataFrame:
    """One row per page file; the page number comes from ``page_NNN.txt`` or a ``page_no=`` folder."""
    rows = spark.read.option("recursiveFileLookup", True).text(glob, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_path"), r".*page_(?:no=)?(\d+)", 1)
    return rows.select(number.cast("int").alias("page_no"), F.col("value").alias("text"))


def read_species_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON array (or lines) of species records."""
    return spark.read.option("recursiveFileLookup", True).schema(schemas.SPECIES_RECORD).json(path, multiLine=True)


def read_image_inventory(spark: SparkSession, root: str, bmp: bool = False) -> DataFrame:
    """Original image files per class folder; contents are not read."""
    kinds = "jpg|jpeg|png" + ("|bmp" if bmp else "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    named = files.where(F.col("path").rlike(rf"(?i)\.({kinds})$") & ~F.element_at(F.split("path", "/"), -1).contains("_aug"))
    return named.select("path", F.element_at(F.split("path", "/"), -2).alias("class_name"), "length")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; unreadable files are dropped. Channels come as blue, green, red."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return rows.select(
        F.col("image.origin").alias("path"), F.element_at(F.split("image.origin", "/"), -2).alias("class_name"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"),
    )


def column_audit(df: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Columns of a table and whether their names speak of taxonomy; reads no rows."""
    words = keywords or AUDIT_KEYWORDS
    rows = [(i, c, any(w in c.lower() for w in words)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, taxonomic boolean")


def flatten_sightings(nested: DataFrame) -> DataFrame:
    """Stored nested sightings to the flat table; the risk level sits under the analysis."""
    return nested.select(
        F.col("_id").alias("sighting_id"), "owner", F.col("imagePath").alias("image_path"), F.col("fromVideo").alias("from_video"),
        F.get("location.coordinates", F.lit(0)).alias("lng"), F.get("location.coordinates", F.lit(1)).alias("lat"),
        F.col("analysis.predictedSpecies").alias("predicted_species"), F.col("analysis.confidence").alias("confidence"),
        F.col("analysis.llm.status").alias("llm_status"), F.col("analysis.llm.details.risk_level").alias("risk_level"),
        F.col("createdAt").cast("timestamp").alias("created_at"), F.col("capturedAt").cast("timestamp").alias("captured_at"),
        F.col("isRemoved").alias("is_removed"), F.col("removedAt").cast("timestamp").alias("removed_at"), F.col("removedBy").alias("removed_by"),
    )
