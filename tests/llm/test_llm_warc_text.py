"""The text of a page against its steps, taken one by one."""

import random

from pyspark.sql import functions as F

from sightline.llm import warc


def _one_by_one(html):
    for pattern, to in warc.TEXT_STEPS:
        html = F.regexp_replace(html, pattern, to)
    for name, to in warc.ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(to))
    for pattern, to in warc.SPACE_STEPS:
        html = F.regexp_replace(html, pattern, to)
    return F.btrim(html, F.lit(" \n"))


def test_text_is_that_of_the_steps(spark):
    parts = [name for name, _ in warc.ENTITIES] + [
        "&", "amp;", "#38;", "lt;", ";", "&am", "&;", "&nbsp", "&ntilde", " ", "  ", " ", "\n", "\t", "\r", "\x0b", "x", "ü", "😀", "<", "<p>", "</p>", "<b>",
        "<script>", "</script>", "<style>", "</style>", "<!--", "-->",
    ]
    draw = random.Random(5)
    odd = [None, "", "&", "&&", "&#38;#38;amp;", "a&amp;lt;", "&#38;lt;", " \n \n ", "&amp;" * 50_000, "a \n" * 50_000]
    pages = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randint(0, 25))),) for _ in range(4000)] + [(x,) for x in odd], "html string")
    both = pages.select("html", _one_by_one(F.col("html")).alias("steps"), warc.plain_text(F.col("html")).alias("text"))
    assert both.where(~F.col("steps").eqNullSafe(F.col("text"))).collect() == []


def test_ampersands_are_replaced_last(spark):
    pages = spark.createDataFrame([("a&amp;lt;b",), ("&#38;amp;",), ("&lt",), ("&eacute;&copy;;",), ("x&hellip;",)], "html string")
    assert [r.t for r in pages.select(warc.decoded(F.col("html")).alias("t")).collect()] == ["a&lt;b", "&", "&lt", "é©;", "x…"]
