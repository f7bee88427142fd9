"""From documents to packed training sequences, one operator per stage.

    clean documents -> one of each near-duplicate group -> no live credentials -> mixed sources -> packed sequences

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import mixing, ownership, packing, shingles, site_quality
from sightline.session import cut


def _row_key(docs: DataFrame) -> Column:
    """A key of the whole row; only rows that are equal in all columns share it. Texts go into it by their digest."""
    row = [F.sha2("text", 256).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return F.sha2(F.to_json(F.struct(*row), {"ignoreNullFields": "false"}), 256)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, row by row."""
    scored = site_quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), host="source", path="lang", whole=True)
    return scored.where("keep").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles or more.

    Copies are one text. A text is held by its row with the smallest id, a group by the text with the smallest id, then
    hash; rows without an id come last.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *[f"`{c}`" for c in rest])
    same = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
    texts = docs.groupBy(same.alias("hash")).agg(F.first("text").alias("text"), F.min(row).alias("row"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    rooted = shingles.groups(texts, words=5)
    order = F.struct("row.no_id", "row.doc_id", "hash")
    chosen = texts.select("id", order.alias("order")).join(rooted, "id").groupBy("root").agg(F.min_by("id", "order").alias("id"))
    kept = {"doc_id": F.col("row.doc_id"), "text": F.col("text")}
    return texts.join(chosen, "id", "left_semi").select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live credentials replaced: those of one or two sources. Copies of a text are gone by now."""
    return ownership.redact(docs, ownership.scan(docs, owner="source", repository=["source", "lang"], copied_owners=3, live_owners=2))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the rest of a source that is above its share goes. Draws are by row, not by id."""
    keyed = docs.withColumn("__row", _row_key(docs))
    mixed = mixing.mix(keyed.select(F.col("__row").alias("doc_id"), "text", "source"))
    taken = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").alias("__copies"))
    often = keyed.join(taken, "__row").dropDuplicates(["__row"])  # equal rows: one stands for the copies of all
    often = often.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return often.select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: SQL cannot express the fitted classifier, the fingerprints or the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
