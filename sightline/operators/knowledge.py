"""Species records from field-guide pages: parsing, rejects, merging and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as t
from sightline.functions.arrays import bind
from sightline.operators.containment import contained
from sightline.operators.predicates import looks_like_species
from sightline.session import cut

NARRATIVE = ["where_found", "identification", "treatment", "poisonous"]
SINGLE = ["family", "origin"]


def named_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_no, text) with a header and a species name, and their cleaned text.

    Text and name are made once per page: a row is generated for pages with a name, so no filter is
    moved below the cleaning and computes it again.
    """
    def read(cleaned: Column) -> Column:
        return F.struct(cleaned.alias("cleaned"), F.when(t.has_header(cleaned), t.scientific_name(cleaned)).alias("scientific_name"))

    made = F.array(bind(t.normalize_page(F.col("text")), read))
    return pages.select("page_no", "text", F.inline(F.filter(made, lambda p: p["scientific_name"].isNotNull())))


def parse_pages(pages: DataFrame) -> DataFrame:
    """One record per named page."""
    c = F.col("cleaned")
    return named_pages(pages).select(
        "scientific_name",
        t.split_common_names(F.coalesce(t.grab_block(c, "Common names"), t.grab_block(c, "Common name"))).alias("common_names"),
        t.grab_block(c, "Family").alias("family"),
        t.origin_head(t.grab_block(c, "Origin")).alias("origin"),
        t.grab_block(c, "Where found").alias("where_found"),
        t.identification_block(c).alias("identification"),
        t.treatment_block(c).alias("treatment"),
        t.hazard_sentences(c).alias("poisonous"),
        F.col("page_no").alias("page_hint"),
    )


def reject_report(pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Pages without a record: page, reason and a one-line preview.

    Without ``parsed`` the pages are judged where they lie and no text is moved; with it, pages
    are told apart by their number.
    """
    if parsed is None:
        c = t.normalize_page(F.col("text"))
        missed = pages.where(~(t.has_header(c) & t.scientific_name(c).isNotNull()))
    else:
        missed = pages.join(parsed.select(F.col("page_hint").alias("page_no")), "page_no", "left_anti")
    return missed.select("page_no", F.lit("no_species_or_bad_name").alias("reason"), t.preview(F.col("text")).alias("preview"))


def first_non_null(records: DataFrame, columns: list[str], by: str = "scientific_name", order: str = "page_hint") -> DataFrame:
    """First non-empty value of each column in page order, as partial aggregates."""
    return records.groupBy(by).agg(*[_first_value(c, order).alias(c) for c in columns])


def _first_value(c: str, order: str) -> Column:
    value = F.nullif(F.col(c), F.lit(""))
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def narrative_parts(records: DataFrame) -> DataFrame:
    """(scientific_name, field, page, part): what the narrative fields of a species are joined from, as rows.

    Of equal texts the one of the first page stays; a text that an earlier one of the same field contains goes.
    """
    key = "scientific_name"
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("part")) for c in NARRATIVE])
    distinct = (
        records.select(key, F.col("page_hint").alias("page"), F.inline(parts)).where(F.coalesce("part", F.lit("")) != "")
        .groupBy(key, "field", "part").agg(F.min("page").alias("page"))
    )
    held = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    inner = contained(held, [key, "field"], F.struct("page", "part"))
    return held.join(inner, "id", "left_anti").select(key, "field", "page", "part")


def merge_species(records: DataFrame) -> DataFrame:
    """One record per species from its pages, in page order. ``records`` is read several times.

    Equal texts and equal names of a species fall together, and contained texts go, while they are rows; only what the
    final record holds meets in one place.
    """
    key, page = "scientific_name", "page_hint"
    base = records.groupBy(key).agg(*[_first_value(c, page).alias(c) for c in SINGLE], F.min(page).alias(page))
    spellings = records.select(key, page, F.posexplode("common_names").alias("at", "name"))
    names = (
        spellings.groupBy(key, F.lower("name").alias("lc")).agg(
            F.min(F.struct(F.col(page).alias("page"), F.col("at"))).alias("first"), F.min_by("name", F.struct(page, "at")).alias("name"))
        .groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("common_names"))
    )
    gathered = narrative_parts(records).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "part", "field"))).alias("parts"))

    def field(c: str) -> Column:
        own = F.transform(F.filter("parts", lambda x: x["field"] == c), lambda x: x["part"])
        return F.nullif(F.array_join(own, "\n\n"), F.lit("")).alias(c)

    narrative = gathered.select(key, *[field(c) for c in NARRATIVE])
    return (
        base.join(names, key, "left").join(narrative, key, "left")
        .select(key, F.coalesce("common_names", F.array().cast("array<string>")).alias("common_names"), *SINGLE, *NARRATIVE, page)
    )


def species_documents(entries: DataFrame, source: str = "field guide") -> DataFrame:
    """Stored form of (scientific_name, text): fields, names and lower-case lookup columns."""
    kept = entries.withColumn("scientific_name", t.strip(F.col("scientific_name")))
    docs = kept.where(looks_like_species(F.col("scientific_name"))).withColumn("fields", t.extract_fields(F.col("text")))
    common = F.element_at("fields", F.lit("Common Names"))
    names = F.when(common == t.NOT_FOUND, F.array().cast("array<string>")).otherwise(t.split_names(common))
    return docs.select(
        *[c for c in entries.columns if c not in ("scientific_name", "text")], "scientific_name", names.alias("common_names"), F.lit(source).alias("source"), "text", "fields",
        t.name_key(F.col("scientific_name")).alias("scientific_name_lc"), t.name_keys(names).alias("common_names_lc"),
    )


def latest_per_key(source: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key; one row per key and task is kept before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return source.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(target: DataFrame, source: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``source`` overwrite the target row of their key or are added.

    Returns the merged table and one row of counts. A source row whose key was already there,
    in the target or earlier in the source, counts as an update.
    """
    columns = [c for c in source.columns if c not in (key, order)]
    last = latest_per_key(source, key, order).drop(order).withColumn("_in_source", F.lit(True))
    both = target.withColumn("_in_target", F.lit(True)).alias("t").join(last.alias("s"), key, "full_outer")
    taken = F.coalesce(F.col("_in_source"), F.lit(False))
    merged = both.select(
        key,
        *[F.when(taken, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}")
          for c in target.columns if c != key],
        *[F.col(f"s.{c}") for c in columns if c not in target.columns],
    )
    inserted = both.agg(F.count_if(taken & F.col("_in_target").isNull()).alias("inserted"))
    total = source.agg(F.count(F.lit(1))).scalar()
    counts = inserted.select("inserted", (total - F.col("inserted")).alias("updated"))
    return merged, counts
