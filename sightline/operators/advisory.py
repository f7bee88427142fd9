"""Species lookups and the advice attached to predictions.

Everything that depends on the species alone is computed on the knowledge side, once per
species; only the confidence texts are computed per sighting. The joins carry no hint: the
optimizer broadcasts the knowledge side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text as t
from sightline.functions.risk import action_required, confidence_level
from sightline.operators.ordinals import dense_position
from sightline.operators.predicates import normalise_prediction
from sightline.operators.vectors import knn
from sightline.session import cut

# Keyword ladder of the legal categories, families known to invade, category texts.
LEGAL_KEYWORDS = [
    ("1a", ["immediate", "prohibited", "eradicate"]),
    ("1b", ["control", "remove", "treatment"]),
    ("2", ["commercial", "restricted", "permit"]),
    ("3", ["ornamental", "garden", "decorative"]),
]
INVASIVE_FAMILIES = ["fabaceae", "poaceae", "asteraceae", "solanaceae"]
LEGAL_TEXTS = {
    "1a": "Immediate removal required", "1b": "Control measures required", "2": "Restrictions apply", "3": "Monitor for spread",
}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(t.NOT_FOUND)) != t.NOT_FOUND


def legal_category(treatment: Column) -> Column:
    lowered = F.lower(F.coalesce(treatment, F.lit(t.NOT_FOUND)))
    ladder = None
    for category, words in LEGAL_KEYWORDS:
        hit = lowered.rlike("|".join(words))
        ladder = F.when(hit, category) if ladder is None else ladder.when(hit, category)
    return ladder.when(_known(treatment), "1b").otherwise("Unknown")


def invasive_status(treatment: Column, hazard: Column, family: Column) -> Column:
    return _known(treatment) | _known(hazard) | F.coalesce(F.lower(family).rlike("|".join(INVASIVE_FAMILIES)), F.lit(False))


def name_table(kb: DataFrame, columns: list[str]) -> DataFrame:
    """Lookup keys of a knowledge base: scientific names first, then common names; one row per key."""
    payload = F.struct("scientific_name", *columns)
    exact = kb.select(t.name_key(F.col("scientific_name")).alias("name_key"), F.lit(0).alias("by"), payload.alias("entry"))
    common = kb.select(
        F.explode(t.name_keys(t.split_names(F.nullif("common_names", F.lit(t.NOT_FOUND))))).alias("name_key"), F.lit(1).alias("by"), payload.alias("entry")
    )
    order = F.struct("by", F.col("entry.scientific_name"))
    return exact.unionByName(common).groupBy("name_key").agg(F.min_by("entry", order).alias("entry"), F.min("by").alias("by"))


def species_lookup(df: DataFrame, kb: DataFrame, name: str = "lookup_name", columns: list[str] | None = None) -> DataFrame:
    """Add ``match`` (exact, common or NULL), ``kb_name`` and knowledge columns by normalised name."""
    columns = columns or []
    keys = name_table(kb, columns)
    return (
        df.withColumn("_key", t.name_key(F.col(name))).join(keys, F.col("_key") == F.col("name_key"), "left")
        .withColumns({
            "match": F.when(F.col("by") == 0, "exact").when(F.col("by") == 1, "common"),
            "kb_name": F.col("entry.scientific_name"), **{c: F.col(f"entry.{c}") for c in columns},
        })
        .drop("_key", "name_key", "by", "entry")
    )


def species_fallback(df: DataFrame, kb: DataFrame, taxonomy: DataFrame | None = None, name: str = "lookup_name") -> DataFrame:
    """Exact species, else a relative of the genus, else of the family, else none.

    ``taxonomy`` maps a genus to its family for genera outside the knowledge base. The species
    standing in is the first by name; the disclaimer says which one it is.
    """
    named = kb.select("scientific_name", F.lower(t.genus(F.col("scientific_name"))).alias("genus"), F.lower("family").alias("family"))
    exact = named.groupBy(t.name_key(F.col("scientific_name")).alias("k1")).agg(F.min("scientific_name").alias("exact_name"))
    genera = named.groupBy(F.col("genus").alias("k2")).agg(F.min("scientific_name").alias("genus_name"))
    families = named.groupBy(F.col("family").alias("k3")).agg(F.min("scientific_name").alias("family_name"))
    known = named.select("genus", "family")
    if taxonomy is not None:
        known = known.unionByName(taxonomy.select(F.lower("genus").alias("genus"), F.lower("family").alias("family")))
    family_of = known.groupBy(F.col("genus").alias("k4")).agg(F.min("family").alias("own_family"))
    spaced = F.translate(F.col(name), "_", " ")
    joined = (
        df.withColumns({"_species": t.name_key(spaced), "_genus": F.lower(t.genus(t.strip(spaced)))})
        .join(exact, F.col("_species") == F.col("k1"), "left")
        .join(genera, F.col("_genus") == F.col("k2"), "left")
        .join(family_of, F.col("_genus") == F.col("k4"), "left")
        .join(families, F.col("own_family") == F.col("k3"), "left")
    )
    level = (
        F.when(F.col("exact_name").isNotNull(), "exact").when(F.col("genus_name").isNotNull(), "genus")
        .when(F.col("family_name").isNotNull(), "family").otherwise("none")
    )
    used = F.coalesce("exact_name", "genus_name", "family_name")
    relative = F.concat(
        F.lit("This advisory is based on "), used, F.lit(" characteristics as no specific data exists for "), spaced
    )
    low = F.when(level == "exact", 1.0).when(level == "genus", 0.6).when(level == "family", 0.3).otherwise(0.0)
    high = F.when(level == "exact", 1.0).when(level == "genus", 0.8).when(level == "family", 0.5).otherwise(0.0)
    disclaimer = (
        F.when(level == "exact", "Based on exact species match in database")
        .when(level == "none", "Species not found in database - manual identification required").otherwise(relative)
    )
    return joined.withColumns({
        "generalisation_level": level, "used_species": used, "band_low": low, "band_high": high, "disclaimer": disclaimer,
    }).drop("_species", "_genus", "k1", "k2", "k3", "k4", "exact_name", "genus_name", "family_name", "own_family")


def cascade(
    df: DataFrame, kb: DataFrame, taxonomy: DataFrame | None = None, embed: Callable[[Column], Column] | None = None,
    max_distance: float | None = None, name: str = "lookup_name",
) -> DataFrame:
    """Add ``generalisation_level``, ``used_species``, ``band_low``, ``band_high`` and ``disclaimer`` to each row.

    A name is looked up as a species or common name, then by its genus, its family, and last by the nearest scientific
    name within ``max_distance``, if ``embed`` gives the vector of a name. Every distinct name is resolved once, and
    each step sees only what the steps before left open.
    """
    names = cut(df.select(F.col(name).alias("_name")).distinct().withColumn("_id", F.monotonically_increasing_id()))
    found = species_lookup(names, kb, "_name")
    known = F.col("match").isNotNull()
    done = found.where(known).select(
        "_name", F.lit("exact").alias("generalisation_level"), F.col("kb_name").alias("used_species"), F.lit(1.0).alias("band_low"), F.lit(1.0).alias("band_high"),
        F.lit("Based on exact species match in database").alias("disclaimer"))
    relatives = cut(species_fallback(found.where(~known).select("_name", "_id"), kb, taxonomy, "_name"))
    if embed is not None:
        species = cut(dense_position(kb.select("scientific_name").distinct(), [F.col("scientific_name")], "vec_id"))
        open_ = relatives.where("generalisation_level = 'none'").select(F.col("_id").alias("query_id"), embed(F.col("_name")).alias("embedding"))
        near = knn(open_, species.select("vec_id", embed(F.col("scientific_name")).alias("embedding")), 1, max_distance=max_distance)
        near = near.join(species, "vec_id").select(F.col("query_id").alias("_id"), F.col("scientific_name").alias("near_name"))
        text = F.concat(F.lit("This advisory is based on "), F.col("near_name"), F.lit(", the nearest known name to "), F.col("_name"))
        similar = {"generalisation_level": "similar", "band_low": 0.3, "band_high": 0.5}  # as a relative of the family
        relatives = relatives.join(near, "_id", "left").withColumns({
            **{c: F.when(F.col("near_name").isNotNull(), v).otherwise(F.col(c)) for c, v in similar.items()},
            "used_species": F.coalesce("near_name", "used_species"), "disclaimer": F.coalesce(text, "disclaimer")})
    resolved = done.unionByName(relatives.select(*done.columns))
    return df.join(resolved, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def kb_facts(kb: DataFrame, source: str = "field guide") -> DataFrame:
    """Per species: legal category, status and the cleaned texts of the advice."""
    def field(name: str) -> Column:
        return F.coalesce(F.element_at("fields", F.lit(name)), F.lit(t.NOT_FOUND))
    treatment, hazard, family = field("Treatment"), field("Poisonous"), field("Family")
    category, status = legal_category(treatment), invasive_status(treatment, hazard, family)
    return kb.select(
        "scientific_name", "common_names",
        F.struct(
            category.alias("category"), status.alias("invasive"),
            t.safe_extract(field("Common Names")).alias("common"), t.safe_extract(family).alias("family"),
            t.safe_extract(field("Description"), 500).alias("description"), t.safe_extract(field("Where Found"), 350, True).alias("where"),
            t.safe_extract(treatment, 500).alias("treatment"), t.safe_extract(field("Identification")).alias("identification"),
            t.safe_extract(hazard).alias("hazard"), t.safe_extract(field("Origin")).alias("origin"), F.lit(source).alias("source"),
        ).alias("facts"),
    )


def legal_text(category: Column) -> Column:
    chain = None
    for key, words in LEGAL_TEXTS.items():
        chain = F.when(category == key, words) if chain is None else chain.when(category == key, words)
    return F.concat(F.lit("Category "), category, F.lit(" species - "), chain.otherwise("Unknown status"))


def advisory(df: DataFrame, species: str = "lookup_name") -> DataFrame:
    """Add the ``advisory`` struct from ``facts`` (NULL when the species is not known) and ``confidence``."""
    k, name, conf = F.col("facts"), F.col(species), F.col("confidence")
    found = k.isNotNull()
    hit = k["invasive"]
    # Texts of an advisory.
    manual = "Manual identification required"

    def pick(yes: Column, no: str | None) -> Column:
        return F.when(found, yes).otherwise(F.lit(no))

    content = F.struct(
        F.struct(name.alias("scientific_name"), pick(k["common"], "Unknown species").alias("common_names"),
                 pick(k["family"], "Unknown").alias("family")).alias("species_identification"),
        F.struct(pick(k["category"], "Unknown").alias("nemba_category"),
                 pick(legal_text(k["category"]), manual).alias("legal_requirements")).alias("legal_status"),
        pick(k["description"], "This species was not found in our database.").alias("physical_description"),
        pick(k["where"], "Unknown").alias("distribution"),
        pick(k["treatment"], "Consult with local experts for proper identification and management.").alias("control_methods"),
        pick(k["identification"], manual).alias("identification_guide"),
        pick(k["hazard"], "Unknown").alias("poisonous_properties"),
        pick(F.when(hit, "Regular follow-up required for effective control").otherwise("No monitoring required"),
             "Manual identification and assessment required").alias("monitoring_requirements"),
    )
    return df.withColumn("advisory", F.struct(
        pick(F.when(hit, name).otherwise("unknown"), "unknown").alias("classification"),
        F.coalesce(hit, F.lit(False)).alias("invasive_status"),
        content.alias("advisory_content"),
        conf.alias("confidence_score"),
        F.when(found, F.array(k["source"])).otherwise(F.array().cast("array<string>")).alias("data_sources"),
        pick(F.lit("exact"), "none").alias("generalisation_level"),
        pick(F.lit("Based on exact species match in database"),
             "Species not found in database - manual identification required").alias("disclaimer"),
        pick(confidence_level(conf), "Unknown species detected").alias("confidence_level"),
        pick(F.when(hit, "High").otherwise("Low"), "Unknown").alias("risk_level"),
        pick(action_required(conf, hit), "Manual identification and assessment required").alias("action_required"),
        pick(k["origin"], "Unknown").alias("origin"),
    ))


def basic_analysis(df: DataFrame, species: str = "predicted_species") -> DataFrame:
    """Advice when no lookup is possible: texts from the confidence alone."""
    name, conf = F.translate(F.col(species), "_", " "), F.col("confidence")
    pct = t.to_fixed(conf * 100, 1)
    return df.withColumn("basic", F.struct(
        F.concat(F.col(species), F.lit(" ("), pct, F.lit("% confidence)")).alias("summary"),
        F.concat(name, F.lit(" was identified by our AI system with "), pct,
                 F.lit("% confidence. However, detailed botanical information could not be retrieved from our invasive species database.")).alias("description"),
        F.when(conf > 0.8, "Medium").when(conf > 0.6, "Low").otherwise("Unknown").alias("risk_level"),
        F.when(conf > 0.8, "High confidence detection - consider consulting local botanical experts for detailed species information.")
        .when(conf > 0.6, "Moderate confidence - verification recommended before taking action.")
        .otherwise("Low confidence - manual identification required.").alias("action_required"),
    ))


def summary_text(name: Column, level: Column) -> Column:
    return F.concat(name, F.lit(" - "), F.coalesce(level, F.lit("Analysis complete")))


def sighting_advisory(s: DataFrame, kb: DataFrame) -> DataFrame:
    """Each sighting with its advice; sightings of unknown species keep the not-found advice."""
    clean = normalise_prediction(s)
    return advisory(species_lookup(clean, kb_facts(kb), columns=["facts"]))


def advisory_sections(df: DataFrame) -> DataFrame:
    """Flatten ``advisory`` into (section, field, value) rows with their defaults."""
    a = F.col("advisory")
    content = a["advisory_content"]
    ident, legal = content["species_identification"], content["legal_status"]

    def known(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    def informative(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(F.nullif(c, F.lit("")), F.lit(t.NOT_FOUND)), F.lit(default))

    rows = [
        ("species", "Scientific Name", known(ident["scientific_name"], "Unknown")),
        ("species", "Common Names", known(ident["common_names"], "Unknown")),
        ("species", "Family", known(ident["family"], "Unknown")),
        ("legal", "NEMBA Category", known(legal["nemba_category"], "Unknown")),
        ("legal", "Legal Requirements", known(legal["legal_requirements"], "Unknown")),
        ("legal", "Risk Level", known(a["risk_level"], "Unknown")),
        ("legal", "Invasive Status", F.when(a["invasive_status"], "Yes").otherwise("No")),
        ("description", "Physical Description", known(content["physical_description"], "No description available.")),
        ("description", "Origin", known(a["origin"], "Unknown")),
        ("distribution", "Where Found", informative(content["distribution"], "No distribution information available.")),
        ("control", "Control Methods", informative(content["control_methods"], "No control methods available.")),
        ("action", "Action Required", informative(a["action_required"], "No action required.")),
        ("disclaimer", "Disclaimer", known(a["disclaimer"], "No disclaimer.")),
    ]
    packed = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.alias("value")) for s, f, v in rows])
    return df.select(*[c for c in df.columns if c != "advisory"], F.inline(packed))


def json_payload(raw: Column, schema: str) -> Column:
    """Decode the JSON object inside a text; NULL when there is none."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def decode_capture(df: DataFrame, image: str = "image") -> DataFrame:
    """Base64 capture to bytes, size and a generated file name."""
    data = F.unbase64(image)
    return df.withColumns({
        "data": data, "size": F.length(data),
        "file_name": F.concat(F.lit("mobile_capture_"), F.unix_millis("captured_at").cast("string"), F.lit(".jpg")),
    })
