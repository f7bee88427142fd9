"""One query per operator over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    arrow_stream, audio, block_max, coordinate_lists, line_hash, merkle, mixing, ownership, packing, pigeonring, site_quality, suffix_blocks, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


MIX_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5('7:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS draw
  FROM documents),
sources AS MATERIALIZED (
  SELECT source, source_size, 1e0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT sum(source_size)::DOUBLE / sum(weight) AS level FROM sources
  UNION
  SELECT (SELECT (sum(source_size) - coalesce(sum(3e0 * source_size) FILTER (l.level * weight > 3e0 * source_size), 0e0))
                 / coalesce(sum(weight) FILTER (NOT (l.level * weight > 3e0 * source_size)), 1e0) FROM sources)
  FROM levels l),
targets AS (
  SELECT source, source_size, least(3e0 * source_size, (SELECT max(level) FROM levels) * weight) AS target FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_pigeonring_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pigeonring.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", pigeonring.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op9_site_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), host="source", path="lang")


def _secret_sql() -> str:
    def found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""
SELECT row, doc_id, owner, repository, '{kind}' AS kind, {rank} AS rank, value,
       begin AS start, (begin + length(m)) AS "end" FROM (
  SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) - length(m))::BIGINT AS begin FROM (
    SELECT row, doc_id, owner, repository, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS value, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT row, doc_id, owner, repository, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs,
             string_split_regex(text, '{p}') AS gaps FROM docs)))
WHERE length(value) >= {least}"""

    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
         coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
base AS MATERIALIZED ({found("assign", 1, ownership.ASSIGN, 2, 12)} UNION ALL {found("access", 2, ownership.ACCESS, 0, 0)}
  UNION ALL {found("hex", 3, ownership.HEX, 0, 0)}),
held AS (SELECT value, count(DISTINCT owner) AS n_owners FROM base GROUP BY value),
verdicts AS (
  SELECT DISTINCT row, kind, CASE kind WHEN 'copied' THEN 4 ELSE 5 END AS rank, "end" - length(value) AS start, "end" FROM (
    SELECT row, value, "end", CASE WHEN n_owners >= 3 THEN 'copied'
        WHEN n_owners = 1 AND NOT regexp_matches(value, '{ownership.PLACEHOLDER}') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 2 THEN 'live' END AS kind
    FROM base JOIN held USING (value)) WHERE kind IS NOT NULL),
spans AS (SELECT row, kind, rank, start, "end", true AS is_base FROM base UNION ALL SELECT row, kind, rank, start, "end", false FROM verdicts),
lists AS (
  SELECT row, count(*) FILTER (is_base AND rank = 1) AS n_assign, count(*) FILTER (is_base AND rank = 2) AS n_access, count(*) FILTER (is_base AND rank = 3) AS n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") FILTER (is_base) AS base,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (row)"""


@query("op10_secret_ownership", _secret_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ownership.scan(read(spark, sf_dir, "documents"), owner="source", repository=["source", "lang"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(ownership.listed(F.col("base")), 256).alias("base_sha256"),
        ownership.listed(F.col("spans")).alias("spans"),
    )


def _warc_sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def replaced(html: str) -> str:
        for pattern, to in warc.TEXT_STEPS:
            html = f"regexp_replace({html}, {text(pattern)}, {text(to)}, 'g')"
        for name, to in warc.ENTITIES:
            html = f"replace({html}, {text(name)}, {text(to)})"
        for pattern, to in warc.SPACE_STEPS:
            html = f"regexp_replace({html}, {text(pattern)}, {text(to)}, 'g')"
        return f"trim({html}, ' \n')"

    def digest(x: str) -> str:
        groups = " || ".join(f"to_base(('0x' || substr(sha1({x}), {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8))
        return f"'sha1:' || translate({groups}, '{warc.BASE32_FROM}', '{warc.BASE32_TO}')"

    def named(x: str) -> str:
        h = f"md5({x})"
        return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"

    fields = f"""concat_ws(E'\\r\\n', 'http-status: HTTP/1.1 200 OK', 'http-header: Content-Type: text/html; charset=utf-8',
      'http-header: Content-Length: ' || strlen(body), 'source-payload-digest: ' || source_digest, 'conversion: ' || conversion_id,
      'title: ' || trim(regexp_replace(regexp_extract(body, {text(warc.TITLE)}, 1), '[\\x20\\t\\r\\n]+', ' ', 'g')),
      CASE WHEN len(links) > 0 THEN array_to_string(list_transform(links, lambda u: 'outlink: ' || u), E'\\r\\n') ELSE '' END) || E'\\r\\n'"""
    head = """concat_ws(E'\\r\\n', 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: 2024-01-01T00:00:00Z',
      'WARC-Target-URI: ' || target_uri, 'WARC-Refers-To: ' || refers_to, 'WARC-Block-Digest: ' || block_digest, 'X-Source-Payload-Digest: ' || source_digest,
      'Content-Type: ' || CASE warc_type WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain; charset=utf-8' END, 'Content-Length: ' || content_length)"""
    return f"""
WITH source AS MATERIALIZED (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS body, {named("concat_ws(' ', 'response', page_id::VARCHAR, url)")} AS refers_to, {digest("coalesce(html, '')")} AS source_digest
  FROM pages),
named AS MATERIALIZED (
  SELECT *, {named("'metadata ' || refers_to")} AS metadata_id, {named("'conversion ' || refers_to")} AS conversion_id,
    (WITH u AS (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT regexp_extract_all(body, {text(warc.LINK)}, 1) AS l))
     SELECT coalesce(list(x ORDER BY i), []) FROM (SELECT x, min(i) AS i FROM u GROUP BY x)) AS links
  FROM source),
blocks AS (
  SELECT page_id, target_uri, refers_to, source_digest, 'metadata' AS warc_type, metadata_id AS record_id, {fields} AS block FROM named
  UNION ALL
  SELECT page_id, target_uri, refers_to, source_digest, 'conversion', conversion_id, {replaced("body")} FROM named),
records AS (SELECT *, {digest("block")} AS block_digest, strlen(block)::BIGINT AS content_length FROM blocks)
SELECT page_id, warc_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length,
       sha256({head} || E'\\r\\n\\r\\n' || block) AS record_sha256
FROM records"""


@query("op1_warc_derivatives", _warc_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(read(spark, sf_dir, "pages")), "page_id")
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256")
    )


@query("op7_arrow_stream_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_stream.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_suffix_blocks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_blocks.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


@query("op3_audio_features")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.features(audio.store(read(spark, sf_dir, "documents"), "doc_id"))
    spans = F.transform("segments", lambda s: F.concat_ws("-", F.round(s["start_s"], 3).cast("string"), F.round(s["end_s"], 3).cast("string")))
    feature = F.concat_ws(":", F.col("frames").cast("string"), F.size("segments").cast("string"), F.sha2(F.array_join(spans, ","), 256), F.sha2("tensors", 256))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "seconds", F.size("segments").alias("n_segments"),
    )


BM25_SQL = r"""
WITH tokens AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS len FROM documents),
mean AS (SELECT avg(len) AS mean, count(*) AS docs FROM lengths),
impacts AS MATERIALIZED (
  SELECT doc_id, term, n * 2.2e0 / (n + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) AS impact FROM tokens JOIN lengths USING (doc_id), mean),
idf AS (SELECT term, ln(1e0 + (docs - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM tokens, mean GROUP BY term, docs),
scores AS (
  SELECT q.doc_id AS query_id, i.doc_id, round(sum(q.n * idf * impact), 6) AS score
  FROM tokens q JOIN idf USING (term) JOIN impacts i USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 10"""


@query("op4_block_max_search", BM25_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return block_max.search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


MERKLE_SQL = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, {leaf_text} AS leaf, CASE WHEN {parity} = 0 THEN {leaf_tampered} ELSE {leaf_text} END AS tampered FROM documents),
leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM docs),
lower_nodes(tree, level, nth, node, n) AS (
  SELECT tree, 0, nth, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, level + 1, nth // 3, sha256(string_agg(node, '' ORDER BY nth)), max((n + 2) // 3) FROM lower_nodes WHERE n > 1 GROUP BY tree, level, nth // 3),
subroots AS MATERIALIZED (SELECT tree, node AS subroot, max(level) OVER () AS top FROM lower_nodes WHERE n = 1),
upper_nodes(level, nth, node, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, nth // 3, sha256(string_agg(node, '' ORDER BY nth)), max((n + 2) // 3) FROM upper_nodes WHERE n > 1 GROUP BY level, nth // 3),
powers AS (SELECT range AS level, pow(3, range)::BIGINT AS width FROM range(30)),
steps AS (
  SELECT l.tree, l.nth, p.level, coalesce(string_agg(s.node, '' ORDER BY s.nth) FILTER (WHERE s.nth < l.nth // width), '') AS before,
         coalesce(string_agg(s.node, '' ORDER BY s.nth) FILTER (WHERE s.nth > l.nth // width), '') AS after
  FROM leaves l, powers p JOIN lower_nodes s ON s.level = p.level AND s.n > 1
  WHERE s.tree = l.tree AND s.nth // 3 = l.nth // width // 3 GROUP BY ALL),
upper_steps AS (
  SELECT r.tree, p.level, coalesce(string_agg(s.node, '' ORDER BY s.nth) FILTER (WHERE s.nth < r.tree // width), '') AS before,
         coalesce(string_agg(s.node, '' ORDER BY s.nth) FILTER (WHERE s.nth > r.tree // width), '') AS after
  FROM subroots r, powers p JOIN upper_nodes s ON s.level = p.level AND s.n > 1 WHERE s.nth // 3 = r.tree // width // 3 GROUP BY ALL),
path AS MATERIALIZED (
  SELECT tree, nth, row_number() OVER (PARTITION BY tree, nth ORDER BY part, level) AS step, before, after FROM (
    SELECT tree, nth, 0 AS part, level, before, after FROM steps
    UNION ALL SELECT l.tree, l.nth, 1, level, before, after FROM leaves l JOIN upper_steps u ON u.tree = l.tree)),
fold(tree, nth, step, node) AS (
  SELECT tree, nth, 0, tampered FROM leaves
  UNION ALL
  SELECT f.tree, f.nth, f.step + 1, sha256(p.before || f.node || p.after) FROM fold f JOIN path p ON p.tree = f.tree AND p.nth = f.nth AND p.step = f.step + 1),
folded AS (SELECT tree, nth, arg_max(node, step) AS folded_root FROM fold GROUP BY tree, nth),
proof AS (SELECT tree, nth, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY tree, nth)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN folded USING (tree, nth) LEFT JOIN proof USING (tree, nth), (SELECT node AS root FROM upper_nodes WHERE n = 1)"""


def _merkle_sql() -> str:
    def digest(text: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    # the lowest bit of a CRC-32 over the digits, from its bitwise rule
    step = "list_reduce(range(9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    crc = f"list_reduce({digits}, lambda a, b: {step}, 4294967295::BIGINT)"
    return MERKLE_SQL.format(leaf_text=digest("text"), leaf_tampered=digest("replace(text, chr(10), '')"), parity=f"(xor({crc}, 4294967295) % 2)")


@query("op11_merkle_log", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.row_digest(*columns, F.col("text"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, merkle.row_digest(*columns, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf)
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), tampered.alias("tampered"))
    proofs = merkle.build(rows, F.col("leaf"), ["source"], ["doc_id"], [F.col("doc_id"), F.col("tampered")]).proofs()
    folded = merkle.folded(F.col("carry.tampered"), F.col("path"))
    out = proofs.select("carry.doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""


@query("op12_coordinate_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return coordinate_lists.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


LINES_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS MATERIALIZED (SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS nth FROM docs),
keyed AS MATERIALIZED (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM (SELECT keyed.*, coalesce(coalesce(doc_id, 9223372036854775807) > coalesce(first, 9223372036854775807), false) AS dropped FROM keyed LEFT JOIN firsts USING (key)) k GROUP BY row"""


@query("op13_line_hash", LINES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_hash.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
