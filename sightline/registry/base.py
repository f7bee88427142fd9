"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF_SQL = f"TIMESTAMP '{tb.AS_OF}'"


def as_of() -> Column:
    return F.to_timestamp(F.lit(tb.AS_OF))


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its whole-table equivalent for DuckDB."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def over(**views: str) -> Callable[[str], str]:
    """Prefix a SELECT with common table expressions of the named views."""
    texts = ",\n".join(f"{k} AS ({tb.duck(v)})" for k, v in views.items())

    def build(body: str) -> str:
        body = body.strip()
        # a body that opens with WITH [RECURSIVE] goes on with the same list
        if body.upper().startswith("WITH RECURSIVE"):
            return f"WITH RECURSIVE {texts}, {body[len('WITH RECURSIVE'):].strip()}"
        if body.startswith(","):
            return f"WITH {texts} {body}"
        if body.upper().startswith("WITH "):
            return f"WITH {texts}, {body[5:].strip()}"
        return f"WITH {texts} {body}"
    return build


S = over(sightings=tb.SIGHTINGS)

#: Great-circle distance as DuckDB SQL.
def km_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    a = (f"(pow(sin(radians({lat2}-({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lng2}-({lng1}))/2),2))")
    return f"(2*6371.0::DOUBLE*atan2(sqrt({a}), sqrt(greatest(1-{a}, 0))))"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str) -> Column:
    return F.array_join(c, "|")
