"""Knowledge plans: pages to records, records to the stored base, predictions to advice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import advisory as adv
from sightline.operators import knowledge as k
from sightline.operators.predicates import normalise_prediction
from sightline.session import cut


def species_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged records of all pages, and the report of the pages without one.

    Parsing is the costly step and its few columns are read several times, so they are stored once.
    """
    parsed = cut(k.parse_pages(pages))
    return k.merge_species(parsed), k.reject_report(pages)


def knowledge_base(pages: DataFrame, target: DataFrame | None = None, source: str = "field guide") -> tuple[DataFrame, DataFrame]:
    """Stored documents from pages, merged into ``target``; also the upsert counts.

    Every parsed page is one entry and the last page of a species wins, as in repeated ingests.
    """
    docs = cut(k.species_documents(k.named_pages(pages).select("scientific_name", "text", "page_no"), source))
    base = target if target is not None else docs.drop("page_no").limit(0)
    return k.upsert(base, docs, "scientific_name_lc", "page_no")


def advise(predictions: DataFrame, kb: DataFrame, fallback: str = "not_found") -> DataFrame:
    """Predictions with their advice. ``fallback='basic'`` adds the texts for unknown species."""
    clean = normalise_prediction(predictions)
    found = adv.advisory(adv.species_lookup(clean, adv.kb_facts(kb), columns=["facts"]))
    out = found.withColumn("summary", adv.summary_text(F.col("lookup_name"), F.col("advisory.confidence_level")))
    if fallback == "basic":
        out = adv.basic_analysis(out).withColumn("summary", F.when(F.col("facts").isNull(), F.col("basic.summary")).otherwise(F.col("summary")))
    return out


def advise_relatives(
    predictions: DataFrame, kb: DataFrame, taxonomy: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, max_distance: float | None = None,
) -> DataFrame:
    """As :func:`advise`, but species that the base does not hold get the advice of a relative or of the nearest name.

    ``generalisation_level`` says which: exact, genus, family, similar or none.
    """
    clean = normalise_prediction(predictions)
    placed = adv.cascade(clean, kb, taxonomy, embed, max_distance)
    facts = adv.kb_facts(kb).select(F.col("scientific_name").alias("used_species"), "facts")
    found = adv.advisory(placed.join(facts, "used_species", "left"))
    level = F.col("generalisation_level")
    return found.withColumn("advisory", F.col("advisory").withField("generalisation_level", level))
