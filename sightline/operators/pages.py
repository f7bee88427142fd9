"""Page assembly: text blocks with positions become the reading-order text of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.arrays import bind
from sightline.functions.text import COLBREAK, clean_text, strip


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks without the page numbers printed at the top and bottom of a page."""
    body = strip(F.coalesce("text", F.lit("")))
    edge = (F.col("y1") < 0.12 * F.col("page_height")) | (F.col("y0") > 0.88 * F.col("page_height"))
    return blocks.where(((F.col("block_type") == 0) | (body != "")) & ~(body.rlike(r"\A\d{1,3}\z") & edge))


def _split_at(centres: Column, width: Column) -> Column:
    """Middle of the widest gap between block centres, kept near the middle of the page."""
    n = F.size(centres)
    first, last = F.floor(n * 0.10).cast("int"), F.floor(n * 0.90).cast("int")
    trimmed = F.array_distinct(F.when(n > 10, F.slice(centres, first + 1, last - first)).otherwise(centres))
    return bind(trimmed, lambda xs: _widest(xs, width))


def _widest(xs: Column, width: Column) -> Column:
    gaps = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.struct(
        (b - a).alias("gap"), ((a + b) / 2).alias("mid")))
    ranked = F.transform(gaps, lambda g, i: F.struct(
        g["gap"].alias("gap"), g["mid"].between(width * 0.33, width * 0.67).alias("central"), (-i).alias("earlier"), g["mid"].alias("mid")))
    clamped = F.greatest(width * 0.30, F.least(width * 0.70, F.array_max(ranked)["mid"]))
    return F.when(F.size(xs) < 2, width * 0.5).otherwise(clamped)


def gutter_split(blocks: DataFrame) -> DataFrame:
    """Column gutter of each page; a page holds few blocks, so they are gathered per page."""
    centre = (F.col("x0") + F.col("x1")) / 2
    per_page = text_blocks(blocks).groupBy("page_no").agg(
        F.max("page_width").alias("w"), F.sort_array(F.collect_list(centre)).alias("xs")
    )
    return per_page.select("page_no", F.when(F.size("xs") < 2, F.col("w") * 0.5).otherwise(_split_at(F.col("xs"), F.col("w"))).alias("split_x"))



def block_order(blocks: DataFrame) -> DataFrame:
    """Blocks with their column (0 left, 1 right) and reading key."""
    kept = text_blocks(blocks)
    split = gutter_split(blocks)
    centre = (F.col("x0") + F.col("x1")) / 2
    return kept.join(split, "page_no").select(
        "page_no", F.when(centre <= F.col("split_x"), 0).otherwise(1).alias("side"), F.bround("y0", 1).alias("y"), "x0", "block_no", "text"
    )


def assemble_pages(blocks: DataFrame, min_chars: int = 100) -> DataFrame:
    """Page text: left column, column break, right column; short pages fall back to block order."""
    centre = (F.col("x0") + F.col("x1")) / 2
    per_page = text_blocks(blocks).groupBy("page_no").agg(
        F.max("page_width").alias("w"), F.sort_array(F.collect_list(centre)).alias("xs"),
        F.sort_array(F.collect_list(F.struct(
            F.bround("y0", 1).alias("y"), F.col("x0").alias("x"), F.col("block_no"), centre.alias("centre"), F.col("text")))).alias("rows"),
    ).withColumn("split_x", F.when(F.size("xs") < 2, F.col("w") * 0.5).otherwise(_split_at(F.col("xs"), F.col("w"))))

    def column(keep) -> Column:
        rows = F.filter("rows", lambda r: keep(r["centre"]) & (F.coalesce(r["text"], F.lit("")) != ""))
        return clean_text(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"))

    split = F.col("split_x")
    both = F.concat(column(lambda c: c <= split), F.lit(f"\n{COLBREAK}\n"), column(lambda c: c > split))
    combined = F.regexp_replace(strip(both), r"\n{3,}", "\n\n")
    in_order = F.sort_array(F.transform("rows", lambda r: F.struct(r["block_no"].alias("block_no"), r["text"].alias("text"))))
    plain = clean_text(F.array_join(F.transform(in_order, lambda r: r["text"]), "\n"))
    return per_page.select("page_no", combined.alias("combined"), plain.alias("plain")).select(
        "page_no", F.when(F.length("combined") < min_chars, F.col("plain")).otherwise(F.col("combined")).alias("text")
    )
