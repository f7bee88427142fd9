"""Photo dataset curation: names, photo ids, sampling, manifests, audits and fetch statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import clean_species
from sightline.operators.ordinals import row_index
from sightline.operators.predicates import filter_cc0

# Hosts and layout of photo addresses.
PHOTO_URLS = [
    r"inaturalist-open-data\.s3\.amazonaws\.com/photos/(\d+)/",
    r"static\.inaturalist\.org/photos/(\d+)/",
]
OPEN_DATA = "https://inaturalist-open-data.s3.amazonaws.com/photos/"
STATIC = "https://static.inaturalist.org/photos/"
QUALITY = "medium"
RETRY_STATUS = (500, 502, 503, 504)


def photo_url(host: str, photo_id: Column, quality: str) -> Column:
    return F.concat(F.lit(host), photo_id.cast("string"), F.lit(f"/{quality}.jpg"))


def licensed_photos(photos: DataFrame) -> DataFrame:
    return photos.where(filter_cc0(F.col("license"))).select("photo_id", "observation_id")


def with_clean_species(obs: DataFrame) -> DataFrame:
    """Species name with its fallbacks, cleaned for use as a folder."""
    unknown = F.concat(F.lit("Unknown_Species_"), F.coalesce("iconic_taxon_name", F.lit("unnamed")))
    return obs.withColumn("species", clean_species(F.coalesce("scientific_name", "common_name", unknown)))


def with_photo_id(obs: DataFrame) -> DataFrame:
    """Photo id from the address, else a numeric observation id; rows without one are dropped."""
    found = [F.nullif(F.regexp_extract("image_url", p, 1), F.lit("")) for p in PHOTO_URLS]
    own = F.when(F.col("id").cast("string").rlike(r"^[0-9]+\z"), F.col("id").cast("string"))
    return obs.withColumn("photo_id", F.coalesce(*found, own)).where(F.col("photo_id").isNotNull())


def download_url(url: Column, photo_id: Column, quality: str = QUALITY) -> Column:
    """The address itself when it names an image file, else the open-data address."""
    return F.when(F.lower(url).rlike(r"\.(jpg|jpeg|png)\z"), url).otherwise(photo_url(OPEN_DATA, photo_id, quality))


def candidate_urls(url: Column, photo_id: Column, quality: str = QUALITY) -> Column:
    return F.array_distinct(F.array(url, photo_url(OPEN_DATA, photo_id, quality), photo_url(STATIC, photo_id, quality)))


# ---- joins ---------------------------------------------------------------------------------


def join_obs_taxa(obs_taxa: DataFrame, taxa: DataFrame) -> DataFrame:
    """Observations whose taxon is known, with its cleaned name; a taxon listed twice counts once."""
    names = taxa.groupBy("taxon_id").agg(F.max("name").alias("name"))
    return obs_taxa.join(names, "taxon_id").select("observation_uuid", "taxon_id", "name", clean_species(F.col("name")).alias("species"))


def join_photo_species(photos: DataFrame, obs_species: DataFrame) -> DataFrame:
    """Photos whose observation has a species."""
    keyed = obs_species.groupBy(F.col("observation_uuid").alias("observation_id")).agg(F.max("species").alias("species"))
    return photos.join(keyed, "observation_id").select("photo_id", "observation_id", "species")


def manifest_pending(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    return manifest.join(inventory.select("path"), "path", "left_anti")


def remaining(work: DataFrame, completed: DataFrame, key: str | list[str]) -> DataFrame:
    """Work whose key was not completed yet."""
    keys = [key] if isinstance(key, str) else key
    return work.join(completed.select(*keys), keys, "left_anti")


def union_chunks(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# ---- sampling ------------------------------------------------------------------------------


def draw(id_: Column | str, seed: int = 42) -> Column:
    """Repeatable random order of ids, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string") if isinstance(id_, str) else id_.cast("string")))


def first_per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group.

    Comparing the row number with a constant lets Spark keep only ``k`` rows per group in every
    task before the shuffle, so a hot group never travels whole.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def sample_per_group(df: DataFrame, by: str, id: str, k: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of at most ``k`` rows per group."""
    return first_per_group(df, by, [draw(id, seed), F.col(id)], k)


def cap_per_class(inv: DataFrame, factor: int = 8, cap: int = 300, seed: int = 42) -> DataFrame:
    """Originals kept per class so that ``factor`` versions of each stay within ``cap``.

    A class within the cap has at most ``cap div factor`` images, so one sample serves both cases.
    """
    return sample_per_group(inv, "class_name", "path", cap // factor, seed)


def photos_per_species(df: DataFrame, min_n: int = 20, max_n: int = 20, seed: int = 42, id: str = "photo_id") -> DataFrame:
    """Species with at least ``min_n`` photos, at most ``max_n`` of each."""
    if max_n < min_n:
        return df.limit(0)
    enough = df.groupBy("species").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n).select("species")
    return sample_per_group(df, "species", id, max_n, seed).join(enough, "species", "left_semi")


def photos_per_observation(df: DataFrame, max_obs: int = 20, max_photos: int = 20, seed: int = 42, quality: str = QUALITY) -> DataFrame:
    """Manifest without species: the first photos of a sample of observations."""
    picked = df.select("observation_id").distinct().orderBy(draw("observation_id", seed), "observation_id").limit(max_obs)
    kept = first_per_group(df.join(picked, "observation_id", "left_semi"), "observation_id", [F.col("photo_id")], max_photos)
    folder = F.concat(F.lit("observation_"), F.col("observation_id").cast("string"))
    return kept.select(
        photo_url(OPEN_DATA, F.col("photo_id"), quality).alias("url"),
        F.concat(folder, F.lit("/"), F.col("photo_id").cast("string"), F.lit(".jpg")).alias("path"), "photo_id", "observation_id",
    )


def batch_number(df: DataFrame, by: str, id: str, n: int = 300) -> DataFrame:
    """Batches of ``n`` rows inside each group, in id order."""
    numbered = row_index(df, [by], [F.col(id)], "_idx")
    return numbered.withColumn("batch", F.floor(F.col("_idx") / n)).drop("_idx")


def file_counter(inv: DataFrame) -> DataFrame:
    """Position of each image inside its class, in path order."""
    return row_index(inv, ["class_name"], [F.col("path")], "counter")


def class_index(inv: DataFrame) -> DataFrame:
    """Label of each image: position of its class among the sorted class names."""
    labels = row_index(inv.select("class_name").distinct(), [], [F.col("class_name")], "label")
    return inv.join(labels, "class_name")


# ---- audits --------------------------------------------------------------------------------


def class_counts(inv: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Images per class; ``classes`` adds the empty ones."""
    counts = inv.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return counts
    return classes.select("class_name").distinct().join(counts, "class_name", "left").select(
        "class_name", F.coalesce("n", F.lit(0)).alias("n")
    )


def dataset_audit(counts: DataFrame) -> DataFrame:
    """One row about class sizes; the median is the upper one."""
    n = F.col("n")
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("images"), F.count(F.lit(1)).alias("folders"),
        F.count_if(F.col("class_name").startswith("observation_")).alias("observation_folders"),
        F.count_if(~F.col("class_name").startswith("observation_")).alias("species_folders"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)"), F.lit(0)).cast("long").alias("median_size"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_size"), F.coalesce(F.max(n), F.lit(0)).alias("max_size"),
        F.count_if((n > 0) & (n < 10)).alias("small"), F.count_if(n > 200).alias("large"),
    )


def audit_advice(audit: DataFrame) -> DataFrame:
    """Advice rows that follow from the audit."""
    a = F.col
    # Limits and texts of the advice.
    rules = [
        (1, (a("observation_folders") > 0) & (a("species_folders") == 0),
         "Your dataset is organized by observation ID rather than species."),
        (2, (a("species_folders") > 0) & (a("small") > 0.3 * a("folders")), "Your dataset has many species with too few images."),
        (3, (a("species_folders") > 0) & (a("large") > 0.1 * a("folders")), "Your dataset has some species with very many images."),
        (4, a("images") < 5000, "Your dataset may be too small for robust training."),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("advice_no"), F.lit(t).alias("advice"))) for i, c, t in rules]))
    return audit.select(F.inline(rows))


def below_min_classes(counts: DataFrame, min_n: int = 2) -> DataFrame:
    """Classes too small to keep; folders of single observations are left alone."""
    return counts.where((F.col("n") < min_n) & ~F.col("class_name").startswith("observation_"))


# ---- fetching ------------------------------------------------------------------------------


def fetch_outcomes(manifest: DataFrame, fetch_fn: Callable[[str], tuple[int, bytes | None]], retries: int = 2) -> DataFrame:
    """Try each task's addresses in order with ``fetch_fn(url) -> (status, body)``.

    A server error or an exception is tried again, any other status moves to the next address.
    """

    def attempt(urls: list[str]) -> tuple[bool, str | None]:
        error = None
        for url in urls:
            for left in reversed(range(retries)):
                try:
                    status, _ = fetch_fn(url)
                except Exception as exc:  # a failed task is a row, not a failed job
                    error = str(exc)
                    continue
                if status == 200:
                    return True, None
                error = f"HTTP {status}"
                if not (left and status in RETRY_STATUS):
                    break
        return False, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results = [attempt(list(u)) for u in pdf["urls"]]
            yield pd.DataFrame({
                "path": pdf["path"], "species": pdf["species"], "ok": [r[0] for r in results], "error": [r[1] for r in results],
            })

    return manifest.select("path", "species", "urls").mapInPandas(run, "path string, species string, ok boolean, error string")


def fetch_stats(outcomes: DataFrame) -> DataFrame:
    ok = F.count_if("ok")
    n = F.count(F.lit(1))
    return outcomes.agg(
        n.alias("total"), ok.alias("success"), (n - ok).alias("failed"),
        F.when(n > 0, ok / n * 100).alias("success_pct"), F.when(n > 0, (n - ok) / n * 100).alias("failed_pct"),
    )


def fetch_errors(outcomes: DataFrame, n: int = 5) -> DataFrame:
    failed = outcomes.where(~F.col("ok"))
    return failed.groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(n)


def fetch_weak_classes(outcomes: DataFrame) -> DataFrame:
    """Species whose failures exceed a tenth of their successes."""
    per = outcomes.groupBy("species").agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))
    return per.where(F.col("failed") > F.col("success") * 0.1)
