"""Sinks. Each writes a new folder; readers switch to it once the write is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_photos(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_species_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_sightings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
