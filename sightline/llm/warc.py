"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response record gives a metadata record (application/warc-fields: status, source headers, source digests, title,
links) and, if its payload is text, a conversion record with the plain text. Both refer to the response by its record
id, name each other, and keep the target address, the date and the digests of what they were made from. Record ids are
derived from the response's, so a second run writes the same records.

Only column expressions are used and no row meets another, so nothing is shuffled. A tag ends at its first ">".

Defined results: a NULL block is an empty one, without headers or text; header lines whose value is NULL are left out; a
block without an empty line is all headers; equal rows give equal records; an empty table gives an empty result; columns
beyond the named ones are carried only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps from HTML to text: pattern, replacement. Both Java's and RE2's expressions read them alike.
TEXT_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}[\x20\t\r\n>].*?</{t}[\x20\t\r\n]*>", "") for t in ("script", "style", "noscript", "template")),
    (r"(?i)</?(p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|title|article|section|nav|header|footer|main|aside|pre|blockquote|form|option)([\x20\t\r\n/][^>]*)?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
]
#: Named character references and what they stand for; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&quot;", '"'), ("&#34;", '"'),
            ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&copy;", "©"),
            ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"), ("&eacute;", "é"), ("&egrave;", "è"), ("&ntilde;", "ñ"),
            ("&#38;", "&"), ("&amp;", "&")]
SPACE_STEPS = [("[\\x20\\t\\r\\x0B\\x0C ]+", " "), (r"\x20?\n[\x20\n]*", "\n")]
#: The same as ``SPACE_STEPS``, but a single space and a single line end, which stay as they are, are not matched.
_SPACE_CHANGES = [("[\\x20\\t\\r\\x0B\\x0C ]{2,}|[\\t\\r\\x0B\\x0C ]", " "), (r"\x20\n[\x20\n]*|\n[\x20\n]+", "\n")]
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"""(?i)<a[\x20\t\r\n][^>]*?href[\x20]*=[\x20]*["']([^"'>]*)["']"""
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def _steps(html: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        html = F.regexp_replace(html, pattern, to)
    return html


def decoded(html: Column) -> Column:
    """``html`` with ``ENTITIES`` replaced in their order, found at the ampersands instead of in one pass over the page each.

    Only references to the ampersand can bring forth another reference, so the rest may be replaced in any order.
    """
    names = {name[1:-1]: to for name, to in ENTITIES if to != "&"}
    stands_for = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    longest = max(map(len, names))

    def piece(p: Column, i: Column) -> Column:
        stop = F.instr(F.left(p, F.lit(longest + 1)), ";")
        to = F.when(stop > 1, F.try_element_at(stands_for, F.left(p, stop - 1)))
        found = F.concat(to, p.substr(stop + 1, F.length(p)))
        return F.when(i == 0, p).otherwise(F.coalesce(found, F.concat(F.lit("&"), p)))

    html = F.array_join(F.transform(F.split(html, "&"), piece), "")
    for name in [name for name, to in ENTITIES if to == "&"]:
        html = F.replace(html, F.lit(name), F.lit("&"))
    return html


def plain_text(html: Column) -> Column:
    """The text of a page: no markup, one line per block, single spaces. ``TEXT_STEPS``, ``ENTITIES`` and ``SPACE_STEPS`` say what is replaced."""
    return F.btrim(_steps(decoded(_steps(html, TEXT_STEPS)), _SPACE_CHANGES), F.lit(" \n"))


def sha1_digest(block: Column) -> Column:
    """The labelled SHA-1 in base 32, as WARC headers have it."""
    digits = F.sha1(block)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), BASE32_FROM, BASE32_TO))


def named_id(name: Column) -> Column:
    """A record id derived from a name."""
    h = F.md5(name)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html): the page as the body of an HTTP answer."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        "page_id",
        named_id(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, F.lit(END + END), body).alias("block"),
        sha1_digest(body).alias("payload_digest"),
    )


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record(kind: str, media: str, block: Column, digest: Column) -> Column:
    lines = F.concat_ws(
        END, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), _header("WARC-Record-ID", F.col(f"{kind}_id")), _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", F.col("target_uri")), _header("WARC-Refers-To", F.col("record_id")), _header("WARC-Block-Digest", digest),
        _header("X-Source-Payload-Digest", F.col("payload_digest")), F.lit(f"Content-Type: {media}"), _header("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.struct(
        F.lit(kind).alias("warc_type"), F.col(f"{kind}_id").alias("record_id"), digest.alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"), F.concat(lines, F.lit(END + END), block).alias("record"),
    )


def derivatives(source: DataFrame, *keep: str) -> DataFrame:
    """Two records per response, one if its payload isn't text.

    ``source`` has record_id, target_uri, date, block (HTTP head and body) and payload_digest. The result has
    warc_type, record_id, refers_to, target_uri, date, source_digest, block_digest, content_length, record and the
    columns in ``keep``. ``record`` lacks the two line ends that close a record; ``write`` adds them.
    """
    block = F.coalesce("block", F.lit(""))
    at = F.instr(block, END + END)
    parsed = source.select(
        *keep, "record_id", "target_uri", "date", "payload_digest",
        F.when(at > 0, F.left(block, at - 1)).otherwise(block).alias("head"),
        F.when(at > 0, block.substr(at + 4, F.length(block))).otherwise("").alias("body"),
        named_id(F.concat_ws(" ", F.lit("metadata"), "record_id")).alias("metadata_id"),
        named_id(F.concat_ws(" ", F.lit("conversion"), "record_id")).alias("conversion_id"),
    )
    media = F.lower(F.trim(F.regexp_extract("head", r"(?i)\ncontent-type:([^;\r\n]*)", 1)))
    is_text = media.isin("text/html", "application/xhtml+xml", "text/plain")
    text = F.when(media == "text/plain", F.col("body")).otherwise(plain_text(F.col("body")))
    links = F.array_distinct(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)))
    fields = F.concat_ws(
        END,
        _header("http-status", F.substring_index("head", END, 1)),
        F.concat_ws(END, F.transform(F.slice(F.split("head", END), F.lit(2), F.length("head")), lambda h: F.concat(F.lit("http-header: "), h))),
        _header("source-payload-digest", F.col("payload_digest")),
        F.when(is_text, _header("conversion", F.col("conversion_id"))),
        _header("title", F.trim(F.regexp_replace(F.regexp_extract("body", TITLE, 1), r"[\x20\t\r\n]+", " "))),
        F.concat_ws(END, F.transform(links, lambda u: F.concat(F.lit("outlink: "), u))),
    )
    made = parsed.withColumn("text", F.when(is_text, text)).withColumn("fields", F.concat(fields, F.lit(END)))
    made = made.withColumns({f"{c}_digest": sha1_digest(F.col(c)) for c in ("text", "fields")})
    metadata = _record("metadata", "application/warc-fields", F.col("fields"), F.col("fields_digest"))
    conversion = _record("conversion", "text/plain; charset=utf-8", F.col("text"), F.col("text_digest"))
    both = F.array(metadata, F.when(F.col("text").isNotNull(), conversion))
    return (
        made.withColumn("made", F.explode(F.array_compact(both)))
        .select(*keep, "made.warc_type", "made.record_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
                F.col("payload_digest").alias("source_digest"), "made.block_digest", "made.content_length", "made.record")
    )


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files: records one after the other, each closed by two line ends."""
    records.select("record").write.option("lineSep", END + END).option("compression", compression).text(path)
