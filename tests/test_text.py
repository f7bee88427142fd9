"""Page text functions on small hand-made pages; expected values were worked out by hand."""

from pyspark.sql import functions as F
import pytest

from sightline.functions import text as t
from sightline.operators import knowledge as k
from sightline.plans import knowledge_base as plan

PAGE_1 = """ND
Testus primus

Family: Testaceae
Common names: Primal weed, first-weed / Alpha
Herb

Origin: Atlantis - lost (1)
Soft stems.

Where found?
Near rivers (3)
and dams.
<<COLBREAK>>
(9)
Sap is toxic to goats. Flowers red.

Not to be confused with
Testus
secundus, taller.

Treatment
Pull by hand."""
PAGE_2 = """Older text.
<<COLBREAK>>
Testus primus (cont.)
1b

Family: Othereae
Common names: ALPHA, Beta weed

Treatment
Pull by hand.

Where found?
Hills."""
PAGE_3 = "Badus Nomen\n\nFamily: X"
PAGE_4 = "Only prose here. " * 20


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE_1), (2, PAGE_2), (3, PAGE_3), (4, PAGE_4)], "page_no int, text string")


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


def test_page_record(spark, pages):
    r = {x["page_hint"]: x for x in k.parse_pages(pages).collect()}
    assert set(r) == {1, 2}
    first = r[1]
    assert first["scientific_name"] == "Testus primus"
    assert first["family"] == "Testaceae"
    assert first["common_names"] == ["Primal weed", "first-weed", "Alpha"]
    assert first["origin"] == "Atlantis"
    assert first["where_found"] == "Near rivers \nand dams."
    assert first["identification"] == "Testus\nsecundus, taller."
    assert first["treatment"] == "Pull by hand."
    assert first["poisonous"] == "Sap is toxic to goats."


def test_merge_and_rejects(pages):
    merged, rejects = plan.species_records(pages)
    row = merged.collect()
    assert len(row) == 1
    row = row[0]
    assert row["family"] == "Testaceae"
    assert row["common_names"] == ["Primal weed", "first-weed", "Alpha", "Beta weed"]
    assert row["treatment"] == "Pull by hand."
    assert row["where_found"] == "Near rivers \nand dams.\n\nHills."
    assert row["page_hint"] == 1
    out = {r["page_no"]: r for r in rejects.collect()}
    assert set(out) == {3, 4}
    assert out[3]["preview"] == "Badus Nomen  Family: X"
    assert len(out[4]["preview"]) == 221 and out[4]["preview"].endswith("…")


def test_name_inside_header_text(spark):
    text = "a stand of Quercus robur in spring\nFamily: Y"
    assert one(spark, text, t.scientific_name) == "Quercus robur"
    assert one(spark, "Origin Quercus robur\nSalix alba text\nFamily: Y", t.scientific_name) == "Salix alba"
    assert one(spark, "Where found\nFamily: Y", t.scientific_name) is None
    assert one(spark, "No header at all", t.scientific_name) is None


@pytest.mark.parametrize("name, species", [("Rosa x/y", "Rosa_x_y"), ("A\\B", "A_B"), ("Malus 'Épine'", "Malus_pine")])
def test_clean_species(spark, name, species):
    assert one(spark, name, t.clean_species) == species


def test_clean_text(spark):
    raw = "ﬁ ﬂow ‘x’\tend-\nless \n 12 \n  tail  \n1234\n"
    assert one(spark, raw, t.clean_text) == "fi flow ‘x' endless\ntail\n1234"


def test_clean_noise_and_origin(spark):
    assert one(spark, "(f)\n(9)\na)\nSHOUTED HEADING\nkept line\n", t.clean_noise) == "kept line"
    assert one(spark, "Peru – high\nrest here", t.origin_head) == "Peru"
    assert one(spark, "Peru.\nrest here\n(4)", t.origin_tail) == "rest here"


def test_hazards(spark):
    text = "It is Toxic. it is toxic. Nontoxical is fine. Causes a rash!"
    assert one(spark, text, t.hazard_sentences) == "It is Toxic. Causes a rash!"
    assert one(spark, "Plain.", t.hazard_sentences) is None
    assert one(spark, "Plain.", t.hazard_sentences_kw) == "Not found"
    assert one(spark, "Nontoxical leaf. Fine.", t.hazard_sentences_kw) == "Nontoxical leaf."


def test_safe_extract(spark):
    assert one(spark, "? Near  rivers (3) 12 and x9", lambda c: t.safe_extract(c, 350, True)) == "Near rivers and x9"
    long = one(spark, "word " * 100, lambda c: t.safe_extract(c, 50))
    assert long.endswith("...") and len(long) <= 53


def test_extract_fields(spark):
    f = one(spark, PAGE_1.replace("<<COLBREAK>>\n", ""), t.extract_fields)
    assert f["Family"] == "Testaceae"
    assert f["Common Names"] == "Primal weed, first-weed / Alpha Herb"
    assert f["Origin"] == "Atlantis - lost (1)"
    assert f["Description"] == "Soft stems."
    assert f["Treatment"] == "Pull by hand."
    empty = one(spark, "", t.extract_fields)
    assert set(empty.values()) == {"Not found"}


def test_small_texts(spark):
    assert one(spark, "Acacia_mearnsii", t.genus) == "Acacia"
    assert one(spark, 0.25, lambda c: t.to_fixed(c, 1), "double") == "0.3"
    assert one(spark, None, t.percent_text, "double") == "Unknown"
    assert one(spark, "Abcdefghijklmnop", t.label_short) == "Abcdefghijkl..."
    assert one(spark, "a b/c.jpg", t.safe_file_name) == "a_b_c.jpg"


def test_knowledge_base_last_page_wins(pages):
    merged, counts = plan.knowledge_base(pages)
    rows = merged.collect()
    assert [r["scientific_name_lc"] for r in rows] == ["testus primus"]
    assert rows[0]["fields"]["Family"] == "Othereae"
    assert counts.first().asDict() == {"inserted": 1, "updated": 1}


def test_upsert_counts(spark):
    target = spark.createDataFrame([("a", "old", "x"), ("z", "keep", "y")], "k string, v string, extra string")
    source = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("b", "3", 3), ("c", None, 4)], "k string, v string, o int")
    merged, counts = k.upsert(target, source, "k", "o")
    assert {tuple(r) for r in merged.select("k", "v", "extra").collect()} == {
        ("a", "1", "x"), ("b", "3", None), ("c", None, None), ("z", "keep", "y")}
    assert counts.first().asDict() == {"inserted": 2, "updated": 2}
