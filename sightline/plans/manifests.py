"""Dataset plans: download manifests and the training table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import curation as c


def _paths(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.concat_ws("", F.col("species"), F.lit("/"), F.col("species"), F.lit("_"),
                                             F.col("observation_id").cast("string"), F.lit(".jpg")))


def build_manifest(obs: DataFrame, inventory: DataFrame, min_n: int = 20, max_n: int = 20, seed: int = 42) -> DataFrame:
    """Tasks from an observation table: clean names, sample per species, drop what is on disk."""
    usable = c.with_photo_id(c.with_clean_species(obs.dropna(subset=["id", "image_url"]))).withColumn("observation_id", F.col("id"))
    sampled = c.photos_per_species(usable, min_n, max_n, seed, id="observation_id")
    tasks = _paths(sampled).select(
        c.download_url(F.col("image_url"), F.col("photo_id")).alias("url"), "path", "observation_id", "photo_id", "species"
    )
    return c.manifest_pending(tasks, inventory)


def build_manifest_taxa(
    photos: DataFrame, obs_taxa: DataFrame | None, taxa: DataFrame | None, inventory: DataFrame,
    min_n: int = 10, max_n: int = 250, seed: int = 42,
) -> DataFrame:
    """Tasks from licensed photos and taxonomy; without taxonomy, a sample of observations."""
    if obs_taxa is None or taxa is None:
        return c.manifest_pending(c.photos_per_observation(photos, seed=seed), inventory)
    named = c.join_photo_species(photos, c.join_obs_taxa(obs_taxa, taxa))
    sampled = c.photos_per_species(named, min_n, max_n, seed)
    tasks = _paths(sampled).select(
        c.photo_url(c.OPEN_DATA, F.col("photo_id"), c.QUALITY).alias("url"), "path", "photo_id", "observation_id", "species"
    )
    return c.manifest_pending(tasks, inventory)


def training_table(inv: DataFrame, augment_count: int = 10, val: float = 0.2, seed: int = 42, by: str = "image") -> DataFrame:
    """Rows (image, augmentation) with label, method and split, all decided by hashes.

    ``by='image'`` keeps all versions of an image on one side; ``by='row'`` splits the versions.
    """
    def share(*parts: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), *parts)
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    def side(unit: Column) -> Column:
        return F.when(unit < val, "val").otherwise("train")

    if by not in ("image", "row"):
        raise ValueError("by is 'image' or 'row'")
    images = c.class_index(inv.select("path", "class_name"))
    if by == "image":  # one hash per image, before the versions multiply
        images = images.withColumn("split", side(share(F.lit("s"), F.col("path"))))
    rows = images.withColumn("aug", F.explode(F.sequence(F.lit(0), F.lit(augment_count - 1))))
    aug = F.col("aug").cast("string")
    if by == "row":
        rows = rows.withColumn("split", side(share(F.lit("s"), F.col("path"), aug)))
    method = F.when((F.col("aug") == 0) | (share(F.lit("m"), F.col("path"), aug) < 0.6), "realistic").otherwise("seasonal")
    return rows.select("path", "class_name", "label", "aug", method.alias("method"), "split")
