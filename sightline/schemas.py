"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

SIGHTING = T.StructType([
    T.StructField("sighting_id", T.LongType()),
    T.StructField("owner", T.LongType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("from_video", T.BooleanType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("predicted_species", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("llm_status", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("is_removed", T.BooleanType()),
    T.StructField("removed_at", T.TimestampType()),
    T.StructField("removed_by", T.StringType()),
])

OBSERVATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("scientific_name", T.StringType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("iconic_taxon_name", T.StringType()),
])

SPECIES_RECORD = T.StructType([
    T.StructField("scientific_name", T.StringType()),
    T.StructField("common_names", T.ArrayType(T.StringType())),
    T.StructField("family", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("where_found", T.StringType()),
    T.StructField("identification", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("poisonous", T.StringType()),
    T.StructField("page_hint", T.IntegerType()),
])

TEXT_BLOCK = T.StructType([
    T.StructField("page_no", T.LongType()),
    T.StructField("page_width", T.DoubleType()),
    T.StructField("page_height", T.DoubleType()),
    T.StructField("x0", T.DoubleType()),
    T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("block_no", T.IntegerType()),
    T.StructField("block_type", T.IntegerType()),
])

NOTIFICATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("dismissed", T.BooleanType()),
])

#: Layout of the built-in image source, without the origin wrapper.
IMAGE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

IDENTIFICATION = T.StructType([
    T.StructField("scientific_name", T.StringType()),
    T.StructField("common_names", T.StringType()),
    T.StructField("family", T.StringType()),
])
LEGAL = T.StructType([
    T.StructField("nemba_category", T.StringType()),
    T.StructField("legal_requirements", T.StringType()),
])
ADVISORY_CONTENT = T.StructType([
    T.StructField("species_identification", IDENTIFICATION),
    T.StructField("legal_status", LEGAL),
    T.StructField("physical_description", T.StringType()),
    T.StructField("distribution", T.StringType()),
    T.StructField("control_methods", T.StringType()),
    T.StructField("identification_guide", T.StringType()),
    T.StructField("poisonous_properties", T.StringType()),
    T.StructField("monitoring_requirements", T.StringType()),
])
