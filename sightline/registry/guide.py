"""Queries over page texts, species records and the advice built from them."""

from pyspark.sql import functions as F

from sightline.functions import arrays as ar, text as tx
from sightline.operators import advisory as adv, knowledge as kn, pages as pg
from sightline.operators.predicates import (
    NOT_EPITHETS, NOT_SPECIES_PHRASES, looks_like_binomial, looks_like_species, normalise_prediction,
)
from sightline.plans import knowledge_base as kb_plan
from sightline.registry.base import S, joined, over, query, rounded
from sightline.session import cut, new_path
from sightline.sources import readers, tables as tb, writers

P = over(fp=tb.FIELD_PAGES)
B = over(bl=tb.duck_blocks())
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def docs(spark, d):
    return tb.table(spark, d, "documents")


# ---- cleaning over the raw documents -------------------------------------------------------

LIG = "translate(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '’“”' || chr(160), '''\"\" ')"
MARKED = "'ﬁrst ﬂow ’a’ “b”' || chr(10) || '12' || chr(10) || text"


def marked():
    return F.concat(F.lit("ﬁrst ﬂow ’a’ “b”\n12\n"), F.col("text"))


@query("normalize_ligatures", f"SELECT doc_id, {LIG.format(x=MARKED)} AS text FROM documents")
def normalize_ligatures(spark, d):
    return docs(spark, d).select("doc_id", tx.normalize_ligatures(marked()).alias("text"))


DROP = r"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, '^\s*\d{{1,3}}\s*$')), chr(10))"


def clean_sql(x: str) -> str:
    t = f"regexp_replace({LIG.format(x=x)}, '-\\n([a-zA-Z])', '\\1', 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    return strip_sql(DROP.format(x=f"regexp_replace({t}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"))


@query("clean_text", f"SELECT doc_id, {clean_sql(MARKED)} AS text FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(marked()).alias("text"))


@query("drop_page_numbers", f"SELECT doc_id, {DROP.format(x=MARKED)} AS text FROM documents")
def drop_page_numbers(spark, d):
    return docs(spark, d).select("doc_id", tx.drop_page_numbers(marked()).alias("text"))


@query("clean_noise", f"""SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip_sql('l')}),
 lambda t: t <> '' AND NOT regexp_matches(t, '^\\(?[a-zA-Z]\\)?$') AND NOT regexp_matches(t, '^\\(?\\d{{1,3}}\\)?$')
 AND NOT (length(t) >= 12 AND regexp_matches(t, '^[A-Z0-9\\s''&\\-()]+$'))), chr(10)),'') AS text FROM documents""")
def clean_noise(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_noise(F.col("text")).alias("text"))


SENT = r"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
KEYWORDS = "|".join(tx.HAZARD_KEYWORDS)


@query("hazard_sentences_kw", f"""SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(h, ' ') ELSE 'Not found' END AS hazard FROM (
 SELECT doc_id, list_transform(list_filter({SENT.format(x="replace(text, source, ' rash ')")}, lambda s: regexp_matches(lower(s), '{KEYWORDS}')), lambda s: {strip_sql('s')}) AS h
 FROM (SELECT doc_id, replace(text, ' et ', ' RASH ') AS text, source FROM documents))""")
def hazard_sentences_kw(spark, d):
    text = F.replace(F.replace(F.col("text"), F.lit(" et "), F.lit(" RASH ")), F.col("source"), F.lit(" rash "))
    return docs(spark, d).select("doc_id", tx.hazard_sentences_kw(text).alias("hazard"))


@query("preview", "SELECT doc_id, replace(substr(text,1,220), chr(10), ' ') || CASE WHEN length(text) > 220 THEN '…' ELSE '' END AS preview FROM documents")
def preview(spark, d):
    return docs(spark, d).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("safe_extract", r"""SELECT doc_id, CASE WHEN length(t) <= 350 THEN t ELSE """ + strip_sql("substr(t,1,350)") + r""" || '...' END AS text FROM (
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(""" + strip_sql("text || ' (12) 7 x9'") + r""", '\s+', ' ', 'g'), '\(\d+\)', '', 'g'), '\b\d+\b', '', 'g'), '\s{2,}', ' ', 'g') AS t
 FROM documents)""")
def safe_extract(spark, d):
    return docs(spark, d).select("doc_id", tx.safe_extract(F.concat("text", F.lit(" (12) 7 x9"))).alias("text"))


@query("safe_file_name", "SELECT doc_id, regexp_replace(text || source, '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM documents")
def safe_file_name(spark, d):
    return docs(spark, d).select("doc_id", tx.safe_file_name(F.concat("text", "source")).alias("name"))


WORDS = "string_split(replace(text, chr(10), ' '), ' ')"
PAIRS = f"(SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS name FROM (SELECT doc_id, {WORDS} AS w FROM documents))"


def words():
    return F.split(F.translate("text", "\n", " "), " ")


def word_pairs(spark, d):
    """Every word of every document with the next one."""
    first, second = F.slice(words(), 1, F.greatest(F.size(words()) - 1, F.lit(0))), F.slice(words(), 2, F.size(words()))
    return docs(spark, d).select("doc_id", F.explode(F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))).alias("name"))


@query("looks_like_binomial", f"""SELECT doc_id, count(*) AS names, count(*) FILTER (WHERE regexp_matches(name, '^\\s*\\p{{Lu}}[^\\s\\p{{Lu}}]*\\p{{Ll}}[^\\s\\p{{Lu}}]*\\s+[a-z-]{{3,}}\\s*$')
 AND regexp_extract(name, '(\\S+)\\s*$', 1) NOT IN ({', '.join(f"'{w}'" for w in NOT_EPITHETS)})) AS hits FROM {PAIRS} GROUP BY doc_id""")
def binomial(spark, d):
    return word_pairs(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("names"), F.count_if(looks_like_binomial(F.col("name"))).alias("hits"))


@query("looks_like_species", f"""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(name, '^\\s*\\p{{Lu}}\\S*\\s+\\p{{Ll}}') AND NOT regexp_matches(lower(name), '{'|'.join(NOT_SPECIES_PHRASES)}')) AS hits FROM {PAIRS} GROUP BY doc_id""")
def species_like(spark, d):
    return word_pairs(spark, d).groupBy("doc_id").agg(F.count_if(looks_like_species(F.col("name"))).alias("hits"))


@query("genus", f"SELECT regexp_extract(name, '^([^_ ]*)', 1) AS genus, count(*) AS n FROM {PAIRS} GROUP BY 1")
def genus(spark, d):
    return word_pairs(spark, d).groupBy(tx.genus(F.col("name")).alias("genus")).agg(F.count(F.lit(1)).alias("n"))


UNIQ = "list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"


@query("ordered_name_union", f"""SELECT doc_id, string_agg(name, '|' ORDER BY first) AS names FROM (
 SELECT doc_id, min(i) AS first, arg_min(word, i) AS name FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))
 GROUP BY doc_id, lower(word)) GROUP BY doc_id""")
def ordered_name_union(spark, d):
    names = ar.bind(words(), lambda w: ar.ordered_name_union(w, F.transform(w, F.lower)))
    return docs(spark, d).select("doc_id", F.array_join(names, "|").alias("names"))


@query("name_keys", f"SELECT doc_id, array_to_string(list_transform(list_filter({WORDS}, lambda x: x <> ''), lambda x: lower({strip_sql('x')})), '|') AS keys FROM documents")
def name_keys(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tx.name_keys(words()), "|").alias("keys"))


# ---- field-guide pages ---------------------------------------------------------------------

CLEANED = strip_sql(r"regexp_replace(regexp_replace(regexp_replace(text, '-\n([a-zA-Z])', '\1', 'g'), '\(([a-z]|[0-9]+)\)', '', 'g'), '[ \t]+', ' ', 'g')")
NORMAL = f", np AS (SELECT page_no, text, {CLEANED} AS c FROM fp)"
HEAD = r"list_filter(string_split(string_split(regexp_extract(c, '(?is)^(.*?)Family\s*:', 1), '<<COLBREAK>>')[-1], chr(10)), lambda l: " + strip_sql("l") + " <> '')"
LINE = r"^\s*(?:\d+|ND)?\s*([a-zA-Z][a-z]{2,})\s+(?:x\s+)?([a-z][a-z-]{3,})\s*(?:\((?:cont|cont\.)\))?\s*(?:1[abc]|2|3|ND)?\s*$"
SCI = (f"list_filter(list_transform({HEAD}, lambda l: regexp_extract(l, '(?i){LINE}', 1) || ' ' || regexp_extract(l, '(?i){LINE}', 2)),"
       " lambda n: regexp_matches(n, '^[A-Z][a-z]+ [a-z-]{3,}$'))[1]")


def block_sql(head: str, stops: list[str]) -> str:
    pat = rf"(?mis)^\s*{head}\s*[:\-]?\s*(.+?)(?:\n\s*(?:{'|'.join(stops)})\s*[:\-]?|\n\s*<<COLBREAK>>|\n\n|\z)"
    return strip_sql(f"nullif(regexp_extract(c, '{pat}', 1), '')")


def grab_sql(label: str) -> str:
    return block_sql(rf"(?:\([a-z]\)\s*)?{label}\s*\??", tx.STOP_LABELS)


HAZ = "|".join(tx.HAZARD_TERMS)
HAZARD = ("nullif(array_to_string(" + UNIQ.format(a=(
    "list_transform(list_filter(" + SENT.format(x=r"regexp_replace(replace(c, '<<COLBREAK>>', ' '), '\s+', ' ', 'g')")
    + f", lambda s: regexp_matches(s, '(?i)\\b({HAZ})\\b')), lambda s: {strip_sql('s')})")) + ", ' '), '')")
ORIGIN = "nullif(trim(regexp_split_to_array(list_filter(list_transform(string_split({b}, chr(10)), lambda l: " + strip_sql("l") + "), lambda t: t <> '')[1], '\\s[-–]\\s')[1], ' .'), '')"
TYPES = ", ".join(f"'{t.lower()}'" for t in tx.PLANT_TYPES)
PARTS = ("list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(translate({b}, ';/', ',,'), '\\s*\\n\\s*', ', ', 'g'), ',|\\band\\b'), lambda p: "
         + strip_sql("p") + " <> ''), lambda p: trim(p, ' .,-')), lambda p: lower(p) NOT IN (" + TYPES + "))")
NAMES = UNIQ.format(a=PARTS.format(b="coalesce({n1}, {n2})".format(n1=grab_sql("Common names"), n2=grab_sql("Common name"))))

RECORDS = f"""{NORMAL}
, rec AS (SELECT {SCI} AS scientific_name, {NAMES} AS common_names, {grab_sql('Family')} AS family, {ORIGIN.format(b=grab_sql('Origin'))} AS origin,
 {grab_sql('Where found')} AS where_found, {block_sql('(?:Not to be confused with|Identification)', tx.IDENTIFICATION_STOPS)} AS identification,
 {block_sql('Treatment', tx.TREATMENT_STOPS)} AS treatment, {HAZARD} AS poisonous, page_no AS page_hint
 FROM np WHERE regexp_matches(c, '(?i)Family\\s*:') AND {SCI} IS NOT NULL)"""
RECORD_COLUMNS = "scientific_name, array_to_string(common_names,'|') AS common_names, family, origin, where_found, identification, treatment, poisonous, page_hint"


@query("normalize_page", P(f"{NORMAL} SELECT page_no, c AS text FROM np"))
def normalize_page(spark, d):
    return tb.field_pages(spark, d).select("page_no", tx.normalize_page(F.col("text")).alias("text"))


def cleaned(spark, d):
    return tb.field_pages(spark, d).select("page_no", tx.normalize_page(F.col("text")).alias("c"))


@query("header_region", P(f"{NORMAL} SELECT page_no, array_to_string({HEAD}, chr(10)) AS header FROM np"))
def header_region(spark, d):
    return cleaned(spark, d).select("page_no", tx.header_region(F.col("c")).alias("header"))


@query("scientific_name", P(f"{NORMAL} SELECT page_no, CASE WHEN regexp_matches(c, '(?i)Family\\s*:') THEN {SCI} END AS name FROM np"))
def scientific_name(spark, d):
    return cleaned(spark, d).select("page_no", tx.scientific_name(F.col("c")).alias("name"))


for _key, _label in (("grab_family", "Family"), ("grab_where_found", "Where found"), ("grab_treatment", "Treatment")):
    query(_key, P(f"{NORMAL} SELECT page_no, {grab_sql(_label)} AS block FROM np"))(
        lambda spark, d, label=_label: cleaned(spark, d).select("page_no", tx.grab_block(F.col("c"), label).alias("block")))


@query("identification_block", P(f"{NORMAL} SELECT page_no, {block_sql('(?:Not to be confused with|Identification)', tx.IDENTIFICATION_STOPS)} AS block FROM np"))
def identification_block(spark, d):
    return cleaned(spark, d).select("page_no", tx.identification_block(F.col("c")).alias("block"))


@query("treatment_block", P(f"{NORMAL} SELECT page_no, {block_sql('Treatment', tx.TREATMENT_STOPS)} AS block FROM np"))
def treatment_block(spark, d):
    return cleaned(spark, d).select("page_no", tx.treatment_block(F.col("c")).alias("block"))


@query("origin_head", P(f"{NORMAL} SELECT page_no, {ORIGIN.format(b=grab_sql('Origin'))} AS origin FROM np"))
def origin_head(spark, d):
    return cleaned(spark, d).select("page_no", tx.origin_head(tx.grab_block(F.col("c"), "Origin")).alias("origin"))


@query("split_common_names", P(f"{NORMAL} SELECT page_no, array_to_string({NAMES}, '|') AS names FROM np"))
def split_common_names(spark, d):
    return cleaned(spark, d).select("page_no", F.array_join(tx.split_common_names(tx.grab_block(F.col("c"), "Common names")), "|").alias("names"))


@query("hazard_sentences", P(f"{NORMAL} SELECT page_no, {HAZARD} AS hazard FROM np"))
def hazard_sentences(spark, d):
    return cleaned(spark, d).select("page_no", tx.hazard_sentences(F.col("c")).alias("hazard"))


@query("find_category", P(f"""{NORMAL} SELECT page_no, nullif(lower(regexp_extract(array_to_string({HEAD}, chr(10)), '(?i)\\b(1a|1b|1c|2|3)\\b', 1)), '') AS category FROM np"""))
def find_category(spark, d):
    return cleaned(spark, d).select("page_no", tx.find_category(F.col("c")).alias("category"))


@query("plant_type_guess", P(f"""{NORMAL} SELECT page_no, CASE {' '.join(f"WHEN regexp_matches(c, '(?i){chr(92)}b{t}{chr(92)}b') THEN '{t}'" for t in tx.PLANT_TYPES)} END AS plant_type FROM np"""))
def plant_type_guess(spark, d):
    return cleaned(spark, d).select("page_no", tx.plant_type_guess(F.col("c")).alias("plant_type"))


@query("description_from_origin", P(f"""{NORMAL}, o AS (SELECT page_no, nullif(regexp_extract(c, '(?mis)^\\s*(Origin)\\s*[:\\-]?', 1), '') AS hit,
 {strip_sql("regexp_extract(c, '(?mis)^" + chr(92) + "s*Origin" + chr(92) + "s*[:" + chr(92) + "-]?" + chr(92) + "s*(?:.*?" + chr(92) + "n)?(.*?)(?:" + chr(92) + "n" + chr(92) + "s*(?:" + chr(92) + "(h" + chr(92) + ")" + chr(92) + "s*)?Where found" + chr(92) + "??" + chr(92) + "s*[:" + chr(92) + "-]?|" + chr(92) + "n" + chr(92) + "s*Not to be confused|" + chr(92) + "n" + chr(92) + "s*Treatment|" + chr(92) + "n" + chr(92) + "n|" + chr(92) + "z)', 1)")} AS b FROM np)
SELECT page_no, CASE WHEN hit IS NOT NULL THEN nullif(b, '') END AS description FROM o"""))
def description_from_origin(spark, d):
    return cleaned(spark, d).select("page_no", tx.description_from_origin(F.col("c")).alias("description"))


def records(spark, d):
    return cut(kn.parse_pages(tb.field_pages(spark, d)))


@query("page_records", P(f"{RECORDS} SELECT {RECORD_COLUMNS} FROM rec"))
def page_records(spark, d):
    return records(spark, d).withColumn("common_names", joined("common_names"))


@query("reject_report", P(f"""{RECORDS} SELECT page_no, 'no_species_or_bad_name' AS reason, replace(substr(text,1,220), chr(10), ' ') || CASE WHEN length(text) > 220 THEN '…' ELSE '' END AS preview
FROM fp WHERE page_no NOT IN (SELECT page_hint FROM rec)"""))
def reject_report(spark, d):
    return kn.reject_report(tb.field_pages(spark, d))


def merged_field(c: str) -> str:
    return (f"(SELECT list_reduce(list(t ORDER BY p), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || chr(10) || x END) FROM "
            f"(SELECT {c} AS t, page_hint AS p FROM rec r2 WHERE r2.scientific_name = k.scientific_name AND {c} IS NOT NULL))")


MERGED = f"""{RECORDS}, k AS (SELECT scientific_name, min(page_hint) AS page_hint, arg_min(family, page_hint) FILTER (WHERE family IS NOT NULL) AS family,
 arg_min(origin, page_hint) FILTER (WHERE origin IS NOT NULL) AS origin, flatten(list(common_names ORDER BY page_hint)) AS cn FROM rec GROUP BY 1)"""


@query("species_records", P(f"""{MERGED} SELECT scientific_name, array_to_string({UNIQ.format(a='cn')},'|') AS common_names, family, origin,
 {merged_field('where_found')} AS where_found, {merged_field('identification')} AS identification, {merged_field('treatment')} AS treatment,
 {merged_field('poisonous')} AS poisonous, page_hint FROM k"""))
def species_records(spark, d):
    merged, _ = kb_plan.species_records(tb.field_pages(spark, d))
    return merged.withColumn("common_names", joined("common_names"))


@query("merge_species", P(f"""{MERGED} SELECT scientific_name, len({UNIQ.format(a='cn')}) AS names, length({merged_field('treatment')}) AS treatment_chars,
 {merged_field('where_found')} AS where_found FROM k"""))
def merge_species(spark, d):
    m = kn.merge_species(records(spark, d))
    return m.select("scientific_name", F.size("common_names").cast("long").alias("names"), F.length("treatment").cast("long").alias("treatment_chars"), "where_found")


@query("first_non_null", P(f"{MERGED} SELECT scientific_name, family, origin FROM k"))
def first_non_null(spark, d):
    return kn.first_non_null(records(spark, d), ["family", "origin"])


@query("sink_species_json", P(f"{MERGED} SELECT scientific_name, family, origin, CAST(page_hint AS INTEGER) AS page_hint FROM k"))
def sink_species_json(spark, d):
    path = new_path(spark, "species-json")
    writers.write_species_json(kn.merge_species(records(spark, d)), path)
    return spark.read.schema(readers.schemas.SPECIES_RECORD).json(path).select("scientific_name", "family", "origin", "page_hint")


def field_sql(label: str) -> str:
    stops = "|".join(rf"^\s*{s}[\s:]*" for s in tx.FIELD_LABELS if s.lower() != label.lower())
    pat = rf"(?ims)^\s*({label}[\s:]*\n*)(.*?)(?:\n(?:{stops})|\z)"
    body = strip_sql(f"regexp_replace(regexp_extract(t, '{pat}', 2), '\\s+', ' ', 'g')")
    return f"CASE WHEN regexp_extract(t, '{pat}', 1) <> '' THEN {body} ELSE 'Not found' END"


FIELDS = f""", ft AS (SELECT page_no, regexp_replace({strip_sql('text')}, '\\n\\s*\\n\\s*', chr(10), 'g') AS t FROM fp)
, o AS (SELECT *, {strip_sql("regexp_extract(t, '(?ims)^" + chr(92) + "s*Origin[" + chr(92) + "s:]*" + chr(92) + "n*(.*?)(?:" + chr(92) + "n(?:^" + chr(92) + "s*(?:Where found|Family|Common names|Treatment)[" + chr(92) + "s:]*|" + chr(92) + "z))', 1)")} AS ob FROM ft)"""


@query("extract_fields", P(f"""{FIELDS}
SELECT page_no, {field_sql('Family')} AS family, {field_sql('Common names')} AS common_names, {field_sql('Where found')} AS where_found,
 {field_sql('Treatment')} AS treatment, {strip_sql("regexp_extract(ob, '^([^." + chr(92) + "n]*)', 1)")} AS origin,
 CASE WHEN regexp_matches(ob, '[.\\n]') THEN {strip_sql("regexp_extract(ob, '(?s)^[^." + chr(92) + "n]*[." + chr(92) + "n](.*)$', 1)")} ELSE 'Not found' END AS description FROM o"""))
def extract_fields(spark, d):
    f = tb.field_pages(spark, d).select("page_no", tx.extract_fields(F.col("text")).alias("f"))
    names = {"family": "Family", "common_names": "Common Names", "where_found": "Where Found", "treatment": "Treatment", "origin": "Origin", "description": "Description"}
    return f.select("page_no", *[F.element_at("f", F.lit(v)).alias(k) for k, v in names.items()])


@query("knowledge_base", P(f"""{RECORDS}{FIELDS.replace(', o AS', ', oo AS')}
, e AS (SELECT scientific_name, page_no, t FROM rec JOIN ft ON page_no = page_hint)
, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lower(scientific_name) ORDER BY page_no DESC) = 1)
SELECT lower(scientific_name) AS scientific_name_lc, scientific_name, {field_sql('Family')} AS family, {field_sql('Treatment')} AS treatment FROM l"""))
def knowledge_base(spark, d):
    merged, _ = kb_plan.knowledge_base(tb.field_pages(spark, d))
    return merged.select("scientific_name_lc", "scientific_name", F.element_at("fields", F.lit("Family")).alias("family"),
                         F.element_at("fields", F.lit("Treatment")).alias("treatment"))


# upsert: suppliers' nations as the stored keys, customers as the source rows
UPSERT = """WITH src AS (SELECT lower(c_mktsegment || c_nationkey) AS k, c_name AS v, c_custkey AS o FROM customer),
 tgt AS (SELECT lower('BUILDING' || n_nationkey) AS k, n_name AS v, 'kept' AS extra FROM nation UNION ALL SELECT 'only here', 'x', 'kept'),
 last AS (SELECT k, arg_max(v, o) AS v FROM src GROUP BY 1)"""


def _upsert(spark, d):
    c, n = tb.table(spark, d, "customer"), tb.table(spark, d, "nation")
    source = c.select(F.lower(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("o"))
    target = n.select(F.lower(F.concat(F.lit("BUILDING"), F.col("n_nationkey").cast("string"))).alias("k"), F.col("n_name").alias("v"), F.lit("kept").alias("extra"))
    extra = spark.range(1).select(F.lit("only here").alias("k"), F.lit("x").alias("v"), F.lit("kept").alias("extra"))
    return kn.upsert(target.unionByName(extra), source, "k", "o")


@query("upsert_species", f"{UPSERT} SELECT coalesce(last.k, tgt.k) AS k, coalesce(last.v, tgt.v) AS v, extra FROM tgt FULL JOIN last ON tgt.k = last.k")
def upsert_species(spark, d):
    return _upsert(spark, d)[0]


@query("upsert_counts", f"{UPSERT} SELECT count(*) FILTER (WHERE k NOT IN (SELECT k FROM tgt)) AS inserted, (SELECT count(*) FROM src) - count(*) FILTER (WHERE k NOT IN (SELECT k FROM tgt)) AS updated FROM last")
def upsert_counts(spark, d):
    return _upsert(spark, d)[1]


# ---- text blocks ---------------------------------------------------------------------------

KEPT = f", kb AS (SELECT * FROM (SELECT *, {strip_sql('text')} AS body FROM bl) WHERE (block_type = 0 OR body <> '') AND NOT (regexp_matches(body, '^\\d{{1,3}}$') AND (y1 < 0.12::DOUBLE*page_height OR y0 > 0.88::DOUBLE*page_height)))"
SPLIT = f"""{KEPT}
, cx AS (SELECT page_no, page_width AS w, (x0+x1)/2 AS x, row_number() OVER (PARTITION BY page_no ORDER BY (x0+x1)/2)-1 AS r, count(*) OVER (PARTITION BY page_no) AS n FROM kb)
, tr AS (SELECT DISTINCT page_no, w, x FROM cx WHERE n <= 10 OR (r >= floor(n*0.10::DOUBLE) AND r < floor(n*0.90::DOUBLE)))
, gp AS (SELECT page_no, w, x - lag(x) OVER p AS g, (x + lag(x) OVER p)/2 AS mid, x FROM tr WINDOW p AS (PARTITION BY page_no ORDER BY x))
, best AS (SELECT page_no, mid, w FROM gp WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_no ORDER BY g DESC, CASE WHEN mid BETWEEN w*0.33::DOUBLE AND w*0.67::DOUBLE THEN 0 ELSE 1 END, x) = 1)
, sp AS (SELECT p.page_no, coalesce(greatest(b.w*0.30::DOUBLE, least(b.w*0.70::DOUBLE, mid)), p.w*0.5) AS split_x FROM (SELECT page_no, max(w) AS w FROM cx GROUP BY 1) p LEFT JOIN best b USING (page_no))"""


@query("drop_page_blocks", B(f"{KEPT} SELECT page_no, count(*) AS n FROM kb GROUP BY 1"))
def drop_page_blocks(spark, d):
    return pg.text_blocks(tb.blocks(spark, d)).groupBy("page_no").agg(F.count(F.lit(1)).alias("n"))


@query("gutter_split", B(f"{SPLIT} SELECT page_no, round(split_x,6) AS split_x FROM sp"))
def gutter_split(spark, d):
    return rounded(pg.gutter_split(tb.blocks(spark, d)), "split_x")


@query("block_order", B(f"{SPLIT} SELECT page_no, block_no, CASE WHEN (x0+x1)/2 <= split_x THEN 0 ELSE 1 END AS side, y0 AS y FROM kb JOIN sp USING (page_no)"))
def block_order(spark, d):
    return pg.block_order(tb.blocks(spark, d)).select("page_no", "block_no", "side", "y")


COLS = f"""{SPLIT}
, ln AS (SELECT k.*, (x0+x1)/2 <= split_x AS l FROM kb k JOIN sp USING (page_no))
, col AS (SELECT page_no, coalesce(string_agg(text, chr(10) ORDER BY y0, x0, block_no) FILTER (WHERE l AND text <> ''),'') AS lt,
 coalesce(string_agg(text, chr(10) ORDER BY y0, x0, block_no) FILTER (WHERE NOT l AND text <> ''),'') AS rt, string_agg(text, chr(10) ORDER BY block_no) AS pt FROM ln GROUP BY 1)
, asm AS (SELECT page_no, regexp_replace({strip_sql(f"{clean_sql('lt')} || chr(10) || '<<COLBREAK>>' || chr(10) || {clean_sql('rt')}")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS whole, {clean_sql('pt')} AS plain FROM col)"""


@query("assemble_pages", B(f"{COLS} SELECT page_no, CASE WHEN length(whole) < 100 THEN plain ELSE whole END AS text FROM asm"))
def assemble_pages(spark, d):
    return pg.assemble_pages(tb.blocks(spark, d))


# ---- lookups and advice --------------------------------------------------------------------

K = over(sightings=tb.SIGHTINGS, kb=tb.KNOWLEDGE)
CLEAN_SP = "CASE WHEN coalesce(predicted_species,'') IN ('','undefined','null') THEN 'Unknown species' ELSE predicted_species END"
LOOK = f", cs AS (SELECT sighting_id, {CLEAN_SP} AS sp, replace({CLEAN_SP},'_',' ') AS nm, coalesce(confidence,0) AS conf, sighting_id % 3 AS m FROM sightings)"
#: some predictions carry a common name, some a relative outside the base
VARIED = """, vs AS (SELECT sighting_id, conf, CASE WHEN sighting_id % 9 = 1 THEN ' Gamma SHRUB ' WHEN sighting_id % 9 = 2 THEN 'Acacia melanoxylon'
 WHEN sighting_id % 9 = 3 THEN 'Rosa alba' WHEN sighting_id % 9 = 4 THEN 'Zzz absent' ELSE nm END AS nm FROM cs)"""


def kb(spark):
    """Knowledge literals in stored form."""
    k = tb.knowledge(spark)
    pairs = {"Family": "family", "Common Names": "common_names", "Treatment": "treatment", "Poisonous": "poisonous", "Description": "description",
             "Where Found": "where_found"}
    fields = F.create_map(*[x for a, b in pairs.items() for x in (F.lit(a), F.col(b))])
    return k.select("scientific_name", "common_names", "family", "treatment", "poisonous", fields.alias("fields"))


def varied(spark, d):
    s = normalise_prediction(tb.sightings(spark, d).select("sighting_id", "predicted_species", "confidence"))
    m = F.col("sighting_id") % 9
    name = (F.when(m == 1, " Gamma SHRUB ").when(m == 2, "Acacia melanoxylon").when(m == 3, "Rosa alba").when(m == 4, "Zzz absent")
            .otherwise(F.col("lookup_name")))
    return s.withColumn("lookup_name", name)


MATCH = f"""{LOOK}{VARIED}
, mt AS (SELECT v.*, e.scientific_name AS en, c.scientific_name AS cn FROM vs v LEFT JOIN kb e ON lower(trim(v.nm)) = lower(e.scientific_name)
 LEFT JOIN kb c ON lower(trim(v.nm)) = lower(c.common_names) AND c.common_names <> 'Not found')
, f AS (SELECT mt.sighting_id, conf, nm, en, cn, kb.* FROM mt LEFT JOIN kb ON kb.scientific_name = coalesce(en, cn))"""


@query("species_lookup", K(f"{MATCH} SELECT sighting_id, coalesce(en,cn) AS kb_name, CASE WHEN en IS NOT NULL THEN 'exact' WHEN cn IS NOT NULL THEN 'common' END AS match FROM f"))
def species_lookup(spark, d):
    return adv.species_lookup(varied(spark, d), kb(spark)).select("sighting_id", "kb_name", "match")


@query("species_fallback", K(f"""{LOOK}{VARIED}
, g AS (SELECT split_part(lower(scientific_name),' ',1) AS g, min(scientific_name) AS gn FROM kb GROUP BY 1)
, fam AS (SELECT lower(family) AS fm, min(scientific_name) AS fn FROM kb GROUP BY 1)
, tx AS (SELECT split_part(lower(scientific_name),' ',1) AS g, min(lower(family)) AS fm FROM (SELECT scientific_name, family FROM kb UNION ALL SELECT 'Rosa x', 'Rosaceae') GROUP BY 1)
, j AS (SELECT sighting_id, nm, kb.scientific_name AS en, gn, fn FROM vs LEFT JOIN kb ON lower(trim(nm)) = lower(kb.scientific_name)
 LEFT JOIN g ON g.g = split_part(lower(trim(nm)),' ',1) LEFT JOIN tx ON tx.g = split_part(lower(trim(nm)),' ',1) LEFT JOIN fam ON fam.fm = tx.fm)
SELECT sighting_id, CASE WHEN en IS NOT NULL THEN 'exact' WHEN gn IS NOT NULL THEN 'genus' WHEN fn IS NOT NULL THEN 'family' ELSE 'none' END AS generalisation_level,
 coalesce(en,gn,fn) AS used_species, CASE WHEN en IS NOT NULL THEN 1.0::DOUBLE WHEN gn IS NOT NULL THEN 0.6 WHEN fn IS NOT NULL THEN 0.3 ELSE 0 END AS band_low,
 CASE WHEN en IS NOT NULL THEN 'Based on exact species match in database' WHEN coalesce(gn,fn) IS NULL THEN 'Species not found in database - manual identification required'
  ELSE 'This advisory is based on ' || coalesce(gn,fn) || ' characteristics as no specific data exists for ' || nm END AS disclaimer FROM j"""))
def species_fallback(spark, d):
    taxonomy = spark.sql("SELECT 'Rosa' AS genus, 'Rosaceae' AS family")
    out = adv.species_fallback(varied(spark, d), kb(spark), taxonomy)
    return out.select("sighting_id", "generalisation_level", "used_species", "band_low", "disclaimer")


CATEGORY = """CASE WHEN regexp_matches(lower(treatment),'immediate|prohibited|eradicate') THEN '1a' WHEN regexp_matches(lower(treatment),'control|remove|treatment') THEN '1b'
 WHEN regexp_matches(lower(treatment),'commercial|restricted|permit') THEN '2' WHEN regexp_matches(lower(treatment),'ornamental|garden|decorative') THEN '3'
 WHEN treatment <> 'Not found' THEN '1b' ELSE 'Unknown' END"""
INVASIVE = "(treatment <> 'Not found' OR poisonous <> 'Not found' OR regexp_matches(lower(family),'fabaceae|poaceae|asteraceae|solanaceae'))"
ADVISED = f"""{MATCH}
, a AS (SELECT sighting_id, nm, conf, scientific_name IS NOT NULL AS fnd, {CATEGORY} AS cat, {INVASIVE} AS inv, treatment, family, common_names, description,
 regexp_replace(regexp_replace(where_found, '\\b\\d+\\b', '', 'g'), '\\s{{2,}}', ' ', 'g') AS where_found FROM f)
, b AS (SELECT *, CASE WHEN NOT fnd THEN 'Unknown species detected' WHEN conf > 0.8 THEN 'High confidence detection' WHEN conf > 0.6 THEN 'Moderate confidence detection' ELSE 'Low confidence detection' END AS lv,
 CASE WHEN NOT fnd THEN 'Manual identification and assessment required' WHEN conf > 0.8 THEN CASE WHEN inv THEN 'Immediate action recommended' ELSE 'Monitor for changes' END
  WHEN conf > 0.6 THEN 'Further verification recommended' ELSE 'Manual verification required' END AS act,
 CASE WHEN fnd THEN 'Category ' || cat || ' species - ' || CASE cat WHEN '1a' THEN 'Immediate removal required' WHEN '1b' THEN 'Control measures required'
  WHEN '2' THEN 'Restrictions apply' WHEN '3' THEN 'Monitor for spread' ELSE 'Unknown status' END ELSE 'Manual identification required' END AS legal,
 CASE WHEN NOT fnd THEN 'Unknown' WHEN inv THEN 'High' ELSE 'Low' END AS risk FROM a)"""


def advised(spark, d):
    return adv.advisory(adv.species_lookup(varied(spark, d), adv.kb_facts(kb(spark)), columns=["facts"]))


@query("sighting_advisory", K(f"""{ADVISED.replace(VARIED, VARIED.replace("CASE WHEN sighting_id % 9 = 1", "CASE WHEN false THEN '' WHEN false AND sighting_id % 9 = 1").replace("WHEN sighting_id % 9 =", "WHEN false AND sighting_id % 9 ="))}
SELECT sighting_id, CASE WHEN fnd AND inv THEN nm ELSE 'unknown' END AS classification, coalesce(fnd AND inv, false) AS invasive, lv AS level, risk FROM b"""))
def sighting_advisory(spark, d):
    a = adv.sighting_advisory(tb.sightings(spark, d), kb(spark))
    return a.select("sighting_id", F.col("advisory.classification").alias("classification"), F.col("advisory.invasive_status").alias("invasive"),
                    F.col("advisory.confidence_level").alias("level"), F.col("advisory.risk_level").alias("risk"))


@query("advisory", K(f"""{ADVISED} SELECT sighting_id, CASE WHEN fnd THEN cat ELSE 'Unknown' END AS category, legal, lv AS level, act AS action, risk,
 CASE WHEN fnd THEN treatment ELSE 'Consult with local experts for proper identification and management.' END AS control,
 CASE WHEN fnd THEN where_found ELSE 'Unknown' END AS distribution, CASE WHEN fnd THEN 'exact' ELSE 'none' END AS generalisation FROM b"""))
def advisory(spark, d):
    a, c = F.col("advisory"), F.col("advisory.advisory_content")
    return advised(spark, d).select(
        "sighting_id", c["legal_status"]["nemba_category"].alias("category"), c["legal_status"]["legal_requirements"].alias("legal"),
        a["confidence_level"].alias("level"), a["action_required"].alias("action"), a["risk_level"].alias("risk"),
        c["control_methods"].alias("control"), c["distribution"].alias("distribution"), a["generalisation_level"].alias("generalisation"))


@query("advise", K(f"{ADVISED} SELECT nm || ' - ' || lv AS summary, risk, count(*) AS n FROM b GROUP BY 1,2"))
def advise(spark, d):
    preds = varied(spark, d).select("sighting_id", F.col("lookup_name").alias("predicted_species"), "confidence")
    out = kb_plan.advise(preds, kb(spark))
    return out.groupBy("summary", F.col("advisory.risk_level").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


SLIPS = VARIED.replace("ELSE nm END", "WHEN sighting_id % 9 = 5 THEN 'Bidenz pilosa' ELSE nm END")


def letters_sql(name: str) -> str:
    return "[" + ", ".join(f"length(lower({name})) - length(replace(lower({name}), '{x}', ''))" for x in "abcdefghijklmnopqrstuvwxyz") + "]"


@query("advise_relatives", K(f"""{LOOK}{SLIPS}
, nms AS (SELECT DISTINCT nm FROM vs)
, g AS (SELECT split_part(lower(scientific_name),' ',1) AS g, min(scientific_name) AS gn FROM kb GROUP BY 1)
, fam AS (SELECT lower(family) AS fm, min(scientific_name) AS fn FROM kb GROUP BY 1)
, tx AS (SELECT split_part(lower(scientific_name),' ',1) AS g, min(lower(family)) AS fm FROM (SELECT scientific_name, family FROM kb UNION ALL SELECT 'Rosa x', 'Rosaceae') GROUP BY 1)
, near AS (SELECT nm, arg_min(scientific_name, (d, scientific_name)) AS sn FROM (
  SELECT nm, scientific_name, list_sum(list_transform(list_zip({letters_sql('nm')}, {letters_sql('scientific_name')}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM nms, kb) WHERE d <= 3 GROUP BY nm)
, j AS (SELECT nms.nm, coalesce(e.scientific_name, c.scientific_name) AS en, gn, fn, sn FROM nms LEFT JOIN kb e ON lower(trim(nms.nm)) = lower(e.scientific_name)
  LEFT JOIN kb c ON lower(trim(nms.nm)) = lower(c.common_names) AND c.common_names <> 'Not found'
  LEFT JOIN g ON g.g = split_part(lower(trim(nms.nm)),' ',1) LEFT JOIN tx ON tx.g = split_part(lower(trim(nms.nm)),' ',1) LEFT JOIN fam ON fam.fm = tx.fm LEFT JOIN near USING (nm))
, u AS (SELECT nm, coalesce(en, gn, fn, sn) AS used, CASE WHEN en IS NOT NULL THEN 'exact' WHEN gn IS NOT NULL THEN 'genus' WHEN fn IS NOT NULL THEN 'family' WHEN sn IS NOT NULL THEN 'similar' ELSE 'none' END AS level FROM j)
SELECT sighting_id, level AS generalisation_level, used AS used_species, CASE WHEN used IS NULL THEN 'Unknown' ELSE {CATEGORY} END AS category,
 CASE level WHEN 'exact' THEN 'Based on exact species match in database' WHEN 'none' THEN 'Species not found in database - manual identification required'
  WHEN 'similar' THEN 'This advisory is based on ' || used || ', the nearest known name to ' || nm
  ELSE 'This advisory is based on ' || used || ' characteristics as no specific data exists for ' || nm END AS disclaimer
FROM vs JOIN u USING (nm) LEFT JOIN kb ON kb.scientific_name = used"""))
def advise_relatives(spark, d):
    named = varied(spark, d).select("sighting_id", F.when(F.col("sighting_id") % 9 == 5, "Bidenz pilosa").otherwise(F.col("lookup_name")).alias("predicted_species"), "confidence")
    taxonomy = spark.sql("SELECT 'Rosa' AS genus, 'Rosaceae' AS family")
    out = kb_plan.advise_relatives(named, kb(spark), taxonomy, tx.letter_counts, 3.0)
    level = F.col("advisory.generalisation_level").alias("generalisation_level")
    return out.select("sighting_id", level, "used_species", F.col("advisory.advisory_content")["legal_status"]["nemba_category"].alias("category"), "disclaimer")


@query("legal_category", K(f"{MATCH} SELECT coalesce(en,cn) AS kb_name, {CATEGORY} AS category, {INVASIVE} AS invasive, count(*) AS n FROM f WHERE scientific_name IS NOT NULL GROUP BY 1,2,3"))
def legal_category(spark, d):
    j = adv.species_lookup(varied(spark, d), kb(spark), columns=["treatment", "poisonous", "family"]).where("kb_name IS NOT NULL")
    return j.groupBy("kb_name", adv.legal_category(F.col("treatment")).alias("category"),
                     adv.invasive_status(F.col("treatment"), F.col("poisonous"), F.col("family")).alias("invasive")).agg(F.count(F.lit(1)).alias("n"))


@query("advisory_sections", K(f"""{ADVISED}
SELECT section, field, value, count(*) AS n FROM (
 SELECT 'legal' AS section, 'Legal Requirements' AS field, legal AS value FROM b
 UNION ALL SELECT 'legal', 'Risk Level', risk FROM b
 UNION ALL SELECT 'legal', 'Invasive Status', CASE WHEN fnd AND inv THEN 'Yes' ELSE 'No' END FROM b
 UNION ALL SELECT 'control', 'Control Methods', CASE WHEN NOT fnd THEN 'Consult with local experts for proper identification and management.' ELSE coalesce(nullif(treatment,'Not found'),'No control methods available.') END FROM b
 UNION ALL SELECT 'distribution', 'Where Found', CASE WHEN NOT fnd THEN 'Unknown' ELSE coalesce(nullif(where_found,'Not found'),'No distribution information available.') END FROM b
 UNION ALL SELECT 'action', 'Action Required', act FROM b) GROUP BY 1,2,3"""))
def advisory_sections(spark, d):
    rows = adv.advisory_sections(advised(spark, d).select("sighting_id", "advisory"))
    fields = ["Legal Requirements", "Risk Level", "Invasive Status", "Control Methods", "Where Found", "Action Required"]
    return rows.where(F.col("field").isin(fields)).groupBy("section", "field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("basic_analysis", K(f"""{LOOK}
SELECT sighting_id, sp || ' (' || printf('%.1f', floor(conf*100*10+0.5)/10) || '% confidence)' AS summary, CASE WHEN conf > 0.8 THEN 'Medium' WHEN conf > 0.6 THEN 'Low' ELSE 'Unknown' END AS risk FROM cs"""))
def basic_analysis(spark, d):
    b = adv.basic_analysis(normalise_prediction(tb.sightings(spark, d)))
    return b.select("sighting_id", F.col("basic.summary").alias("summary"), F.col("basic.risk_level").alias("risk"))


@query("cache_key", K(f"{LOOK} SELECT count(DISTINCT regexp_replace(lower(sp),'[^a-z0-9]','','g') || '_' || floor(conf*100+0.5)) AS n FROM cs"))
def cache_key(spark, d):
    s = tb.sightings(spark, d)
    sp = F.coalesce("predicted_species", F.lit("Unknown species"))
    keys = s.select(tx.cache_key(sp, F.coalesce("confidence", F.lit(0.0))).alias("k"))
    return keys.dropDuplicates(["k"]).agg(F.count(F.lit(1)).alias("n"))


@query("json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, d):
    e = tb.table(spark, d, "events")
    return e.select("event_id", adv.json_payload(F.concat(F.lit("log line\n"), "props"), "k BIGINT")["k"].alias("k"))


@query("decode_capture", K("SELECT sighting_id, CAST(octet_length(encode(coalesce(image_path,''))) AS INTEGER) AS size, 'mobile_capture_' || (epoch_us(captured_at) // 1000) || '.jpg' AS file_name FROM sightings"))
def decode_capture(spark, d):
    s = tb.sightings(spark, d).select("sighting_id", "captured_at", F.base64(F.coalesce("image_path", F.lit("")).cast("binary")).alias("image"))
    return adv.decode_capture(s).select("sighting_id", "size", "file_name")
