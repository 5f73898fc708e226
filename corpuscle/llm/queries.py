"""The queries opN_<name>: thin digests of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .html import extract_pages
from .mixing import mix
from .neighbours import nearest
from .pii import KINDS, find_pii
from .quality import classify
from .repeats import remove_repeats
from .simhash import simhash_dedup
from .tokens import count_tokens
from .warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
    )


OP1_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, place.k, item_id FROM place JOIN win ON place.win = win.win AND place.k = win.k),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Target weights of the mix; nodes without one weigh 1.
MIX = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 0.5}}


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX)


#: op5 in SQL: CRC-32 bit by bit, then a water level per parent and level, then running sums in the seeded order.
OP5_SQL = r"""
WITH RECURSIVE src AS (SELECT DISTINCT coalesce(CAST(source AS VARCHAR), '') AS source FROM documents),
crc AS (
  SELECT source, hex(encode(source)) AS h, 0 AS step, CAST(4294967295 AS BIGINT) AS c FROM src
  UNION ALL
  SELECT source, h, step + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT source, h, step, CASE WHEN step % 8 = 0 THEN xor(c, CAST('0x' || substr(h, CAST(2 * (step // 8) + 1 AS BIGINT), 2) AS BIGINT)) ELSE c END AS x FROM crc WHERE step < 4 * len(h))),
origin AS (SELECT source, 'domain' || CAST(xor(c, 4294967295) % 4 AS VARCHAR) AS domain FROM crc WHERE step = 4 * len(h)),
row_ AS (
  SELECT doc_id, domain, coalesce(CAST(lang AS VARCHAR), '') AS lang, origin.source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents JOIN origin ON origin.source = coalesce(CAST(documents.source AS VARCHAR), '')),
leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 4 AS capacity, CASE source WHEN 'src0' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM row_ GROUP BY ALL),
lang_ AS (SELECT domain, lang, sum(capacity) AS capacity, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM leaf GROUP BY domain, lang),
domain_ AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'domain0' THEN 4.0::DOUBLE WHEN 'domain1' THEN 3.0::DOUBLE WHEN 'domain2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lang_ GROUP BY domain),
top1 AS (
  SELECT *, ((SELECT CAST(sum(n_tokens) AS DOUBLE) FROM row_) - coalesce(sum(capacity) OVER (ORDER BY capacity / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY capacity / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM domain_),
top2 AS (SELECT domain, least(capacity, greatest(0, w * max(level) OVER ())) AS given FROM top1),
mid1 AS (
  SELECT lang_.*, (given - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM lang_ JOIN top2 USING (domain)),
mid2 AS (SELECT domain, lang, least(capacity, greatest(0, w * max(level) OVER (PARTITION BY domain))) AS given FROM mid1),
leaf1 AS (
  SELECT leaf.*, (given - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM leaf JOIN mid2 USING (domain, lang)),
leaf2 AS (SELECT *, least(capacity, greatest(0, w * max(level) OVER (PARTITION BY domain, lang))) AS given FROM leaf1),
plan1 AS (SELECT *, CAST(CASE WHEN tokens > 0 THEN floor(given / tokens + 1e-9) ELSE 1 END AS BIGINT) AS whole FROM leaf2),
plan_ AS (SELECT domain, lang, source, whole, CAST(floor(greatest(0, given - whole * tokens) + 1e-6) AS BIGINT) AS rest FROM plan1),
placed AS (
  SELECT row_.*, whole, rest, CAST('0x' || substr(md5('0:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM row_ JOIN plan_ USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN whole < 4 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM run WHERE whole + CASE WHEN whole < 4 AND upto <= rest THEN 1 ELSE 0 END > 0
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: The vocabulary that op7 counts with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def example_edits(key: str = "doc_id", text: str = "text", edits: int = 3) -> Column:
    """Edits by rule: each of a document's gives way up to 19 code points at a hashed place to up to 39 from another."""
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))

    def edit(k: Column) -> Column:
        spot = lambda salt, n: F.pmod(F.xxhash64(F.col(key), k, F.lit(salt)), n)
        put = F.substr(F.coalesce(F.col(text), F.lit("")), (spot(1, size + 1) + 1).cast("int"), spot(2, F.lit(40)).cast("int"))
        return F.struct(spot(3, size + 1).alias("start"), spot(4, F.lit(20)).alias("length"), put.alias("text"))

    return F.transform(F.sequence(F.lit(0), F.lit(edits - 1)), edit)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, example_edits())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def joined(kinds: tuple[str, ...]):
        """Spans come by kind as listed, then start, from the operator."""
        listed = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = KINDS[:4]
    return found.select(
        "doc_id",
        *map(number, base),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


#: op9 in SQL: base 32 from the SHA-1's hex digits, five (four characters) at a time.
OP9_SQL = """
WITH page AS (SELECT page_id, coalesce(CAST(html AS VARCHAR), '') AS payload FROM pages),
hexed AS (SELECT page_id, payload, sha1(payload) AS h FROM page),
cut AS (SELECT page_id, payload, %s FROM hexed),
ranked AS (
  SELECT *, %s AS digest, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY payload) AS kept FROM cut)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN kept END AS refers_to
FROM ranked
""" % (
    ", ".join(f"CAST('0x' || substr(h, {1 + 5 * k}, 5) AS BIGINT) AS v{k}" for k in range(8)),
    " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v{k} >> {s}) & 31) AS BIGINT), 1)" for k in range(8) for s in (15, 10, 5, 0)),
)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neighbours": op2_neighbours,
    "op3_quality": op3_quality,
    "op4_repeats": op4_repeats,
    "op5_mix": op5_mix,
    "op6_simhash": op6_simhash,
    "op7_tokens": op7_tokens,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_html": op10_html,
}
SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op5_mix": OP5_SQL, "op9_warc": OP9_SQL}
