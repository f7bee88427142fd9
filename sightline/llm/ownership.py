"""Secret scans with corpus-wide ownership of every candidate.

Three patterns find candidates in whole texts: assignments to secret-like names, access key ids and long runs of
hexadecimal digits. The hash of each candidate's value is then counted over the whole corpus by the distinct
repositories and owners that hold it. A value that many owners hold is a copied example; one that a single owner holds
and that doesn't look like a placeholder is a live credential.

Only DataFrame expressions are used. Positions come from the text between the matches: a pattern cuts the text into
gaps and matches, whose lengths add up. Values are counted as distinct (hash, repository, owner) rows, which are
combined before they are shuffled, so a value in every third document costs one row per owner and task.

Defined results: a NULL or empty text has no spans; NULL owners and repositories count as one owner or repository; rows
that repeat are one holder; positions are code points, ends exclusive; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut


def either_case(word: str) -> str:
    """A pattern of the word's letters in lower or upper case, other characters unchanged."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = f"({NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # a shorter run holds no longer one
HEX = "[0-9a-f]{16,}"
#: Order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "copied", "live")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000000|1234567"


def _located(text: Column, kind: str, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of all matches: struct(kind, start, end, value_start, value), without those whose value is too short."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value")
    )
    matches = F.filter(parts, lambda p: p["whole"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value_start:int,value:string>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["whole"])
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), (end - F.length(p["value"])).alias("value_start"), p["value"].alias("value")
        )
        kept = F.when(F.length(p["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    return F.aggregate(matches, start, step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    """All candidate spans of a text; texts without a match are left after one look per pattern."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value_start:int,value:string>>")
    found = [
        F.when(text.rlike(pattern), _located(text, kind, pattern, group, least)).otherwise(none)
        for kind, pattern, group, least in (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0))
    ]
    return F.concat(*found)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def listed(spans: Column) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def holders(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners) of all candidate rows (value_hash, repository, owner)."""
    distinct = candidates.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("one"))
    return distinct.groupBy("value_hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def scan(docs: DataFrame, owner: str, repository: list[str], copied_owners: int = 3, live_owners: int = 1) -> DataFrame:
    """One row per document: doc_id, text_hash, base (ordered spans) and spans (base and verdicts, ordered).

    ``docs`` has doc_id, text, the column of owners and those that name a repository. A verdict is a span of its value:
    ``copied`` for values of ``copied_owners`` owners or more, ``live`` for values of ``live_owners`` or fewer that look
    real. Placeholders, and values of owners in between, get no verdict; ``live_owners = copied_owners - 1`` leaves no such gap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = cut(
        docs.select(
            "doc_id",
            F.xxhash64(F.lit("o"), owner).alias("owner"),
            F.xxhash64(F.lit("r"), *repository).alias("repository"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(text, 256).alias("text_hash"),
            base_spans(text).alias("found"),
        )
    )
    candidates = found.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("span"))
    candidates = candidates.withColumn("value_hash", F.sha2("span.value", 256))
    verdicts = holders(candidates).where((F.col("n_owners") <= live_owners) | (F.col("n_owners") >= copied_owners))
    real = ~F.col("span.value").rlike(PLACEHOLDER) & (F.length(F.regexp_replace("span.value", "[^0-9]", "")) >= 2)
    judged = (
        candidates.join(verdicts, "value_hash")
        .withColumn("kind", F.when(F.col("n_owners") >= copied_owners, "copied").when(real, "live"))
        .where(F.col("kind").isNotNull())
        .groupBy("row")
        .agg(F.collect_set(F.struct("kind", F.col("span.value_start").alias("start"), (F.col("span.value_start") + F.length("span.value")).alias("end"))).alias("judged"))
    )
    plain = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return (
        found.join(judged, "row", "left")
        .withColumn("plain", plain)
        .select(
            "doc_id",
            "text_hash",
            ordered(F.col("plain")).alias("base"),
            ordered(F.concat("plain", F.coalesce("judged", F.array().cast("array<struct<kind:string,start:int,end:int>>")))).alias("spans"),
        )
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every live span replaced; spans that touch or overlap are replaced once."""
    live = F.filter(spans, lambda s: s["kind"] == "live")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["end"] <= acc["at"], acc["text"]).when((s["start"] <= acc["at"]) & (acc["at"] > 0), acc["text"]).otherwise(F.concat(acc["text"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("text"))

    return F.aggregate(live, start, step, lambda acc: F.concat(acc["text"], text.substr(acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live credentials replaced in ``text`` and ``n_chars`` counted anew where it changed.

    ``found`` comes from ``scan``. The verdicts of a text depend on the text alone, so they are joined by its hash.
    """
    live = found.where(F.exists("spans", lambda s: s["kind"] == "live")).groupBy(F.col("text_hash").alias("__text_hash")).agg(F.first("spans").alias("__live"))
    held = docs.withColumn("__text_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(live, "__text_hash", "left")
    clean = held.withColumn("__clean", F.when(F.col("__live").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__live"), mark)))
    columns = {"text": F.col("__clean"), "n_chars": F.when(F.col("__live").isNull(), F.col("n_chars")).otherwise(F.length("__clean").cast("long"))}
    return clean.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
