"""The queries of the engine, by name, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import clean, delta, discourse, geometry, human, keyness, lexical, pairs, resample, semantic, syntax
from ..sources.readers import documents, dropped, settled, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of SQL.
_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''))"
_ROWS = f"txt AS (SELECT source AS model_dir, lang AS topic, doc_id AS text_ord, text, {_TOKENS} AS w FROM documents)"
_TOK = f"{_ROWS}, tok AS (SELECT model_dir, topic, text_ord, unnest(w) AS token, unnest(range(len(w))) AS pos FROM txt)"
_CNT = f"{_TOK}, cnt AS (SELECT model_dir, token, count(*) AS c, min({{'m': model_dir, 't': text_ord, 'p': pos}}) AS f FROM tok GROUP BY ALL)"


def _gram_sql(n: int) -> str:
    words = " || ' ' || ".join(f"w[p + {k + 1}]" for k in range(n))
    return (
        f"{_ROWS}, gram AS (SELECT model_dir, text_ord, p AS pos, {words} AS token FROM (SELECT *, unnest(range(greatest(len(w) - {n - 1}, 0))) AS p FROM txt)), "
        "cnt AS (SELECT model_dir, token, count(*) AS c, min({'m': model_dir, 't': text_ord, 'p': pos}) AS f FROM gram GROUP BY ALL)"
    )


_DIVERSITY = (
    "CAST(sum(c) AS BIGINT) AS n_tokens, count(*) AS n_types, round(count(*) / CAST(sum(c) AS DOUBLE), 6) AS ttr, round(count(*) FILTER (c = 1) / CAST(count(*) AS DOUBLE), 6) AS hapax_ratio, "
    "round(10000 * (CAST(sum(c * c) AS DOUBLE) - CAST(sum(c) AS DOUBLE)) / (CAST(sum(c) AS DOUBLE) * CAST(sum(c) AS DOUBLE)), 6) AS yules_k"
)


@query("lexical_profile", f"WITH {_CNT} SELECT model_dir, {_DIVERSITY} FROM cnt GROUP BY model_dir")
def lexical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.profile(documents(spark, sf_dir))


@query(
    "lexical_profile_scoped",
    f"WITH {_TOK}, s AS (SELECT model_dir, topic AS scope, token FROM tok UNION ALL SELECT model_dir, 'pooled', token FROM tok), cnt AS (SELECT model_dir, scope, token, count(*) AS c FROM s GROUP BY ALL) "
    f"SELECT model_dir, scope, {_DIVERSITY} FROM cnt GROUP BY model_dir, scope",
)
def lexical_profile_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.profile_scoped(documents(spark, sf_dir))


def _mattr_sql(w: int) -> str:
    return f"""WITH {_TOK}, st AS (SELECT model_dir, token, row_number() OVER (PARTITION BY model_dir ORDER BY topic, text_ord, pos) AS i, count(*) OVER (PARTITION BY model_dir) AS n FROM tok),
    pr AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY model_dir, token ORDER BY i), 0) AS p, least({w}, n) AS w FROM st)
    SELECT model_dir, n AS n_tokens, round(CAST(sum(greatest(0, least(i, n - w + 1) - greatest(p + 1, i - w + 1, 1) + 1)) AS DOUBLE) / (w * (n - w + 1)), 6) AS mattr FROM pr GROUP BY model_dir, n, w"""


@query("mattr", _mattr_sql(500))
def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.mattr(documents(spark, sf_dir))


@query("mattr_short_corpora", _mattr_sql(25_000))
def mattr_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.mattr(documents(spark, sf_dir), 25_000)


_RANK = "row_number() OVER (PARTITION BY model_dir ORDER BY c DESC, f) AS rank"
_TOP = "SELECT model_dir, CAST(rank AS INTEGER) AS rank, token, c, round(c / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, {r}, sum(c) OVER (PARTITION BY model_dir) AS total FROM cnt) WHERE rank <= {k}"


@query("top_words", f"WITH {_CNT} " + _TOP.format(r=_RANK, k=100))
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.tokens_of(documents(spark, sf_dir)), 100, "model_dir")


@query("top_bigrams", f"WITH {_gram_sql(2)} " + _TOP.format(r=_RANK, k=500))
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.grams_of(documents(spark, sf_dir), 2), 500, "model_dir")


@query("top_trigrams", f"WITH {_gram_sql(3)} " + _TOP.format(r=_RANK, k=500))
def top_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(lexical.grams_of(documents(spark, sf_dir), 3), 500, "model_dir")


@query("zipf_exponent", f"WITH {_CNT}, t AS (SELECT * FROM (SELECT *, {_RANK} FROM cnt) WHERE rank <= 1000) SELECT model_dir, round(CASE WHEN count(*) < 10 THEN 0 ELSE -regr_slope(ln(c), ln(rank)) END, 6) AS zipf FROM t GROUP BY model_dir")
def zipf_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.zipf(documents(spark, sf_dir))


_PAIRS = "m AS (SELECT DISTINCT model_dir FROM top), pr AS (SELECT a.model_dir AS model_a, b.model_dir AS model_b FROM m a, m b WHERE a.model_dir < b.model_dir), " "al AS (SELECT model_a, model_b, token, CAST(sum(x) AS DOUBLE) AS x, CAST(sum(y) AS DOUBLE) AS y FROM (SELECT model_a, model_b, token, c AS x, 0 AS y FROM top JOIN pr ON model_dir = model_a UNION ALL SELECT model_a, model_b, token, 0, c FROM top JOIN pr ON model_dir = model_b) GROUP BY ALL)"


@query("jaccard_top100_pairs", f"WITH {_CNT}, top AS (SELECT model_dir, token, 1 AS c FROM (SELECT *, {_RANK} FROM cnt) WHERE rank <= 100), {_PAIRS} SELECT model_a, model_b, round(sum(x * y) / count(*), 6) AS jaccard FROM al GROUP BY ALL")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.jaccard(documents(spark, sf_dir))


_JSD = (
    "z AS (SELECT *, count(*) OVER w AS k, sum(x) OVER w AS tx, sum(y) OVER w AS ty FROM al WINDOW w AS (PARTITION BY model_a, model_b)), "
    "pq AS (SELECT model_a, model_b, (x / tx + 1e-12::DOUBLE) / (1 + k * 1e-12::DOUBLE) AS p, (y / ty + 1e-12::DOUBLE) / (1 + k * 1e-12::DOUBLE) AS q FROM z), "
    "js AS (SELECT model_a, model_b, round(sum(0.5::DOUBLE * p * log2(p / ((p + q) / 2)) + 0.5::DOUBLE * q * log2(q / ((p + q) / 2))), 6) AS jsd FROM pq GROUP BY ALL)"
)


def _jsd_sql(n: int) -> str:
    return f"WITH {_gram_sql(n)}, top AS (SELECT model_dir, token, c FROM (SELECT *, {_RANK} FROM cnt) WHERE rank <= 500), {_PAIRS}, {_JSD} SELECT * FROM js"


@query("jsd_bigram_pairs", _jsd_sql(2))
def jsd_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.jsd(documents(spark, sf_dir), 2)


@query("jsd_trigram_pairs", _jsd_sql(3))
def jsd_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.jsd(documents(spark, sf_dir), 3)


_LEN = f"val AS (SELECT source AS model_dir, len({_TOKENS}) AS n FROM documents)"
_SENT = rf"""st AS (SELECT source AS model_dir, unnest(list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS text FROM documents),
val AS (SELECT model_dir, len({_TOKENS}) AS n FROM st)"""
_STATS = "SELECT model_dir, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM val GROUP BY model_dir"
_D = "m AS (SELECT model_dir, avg(n) AS mean, var_samp(n) AS v FROM val GROUP BY model_dir) SELECT a.model_dir AS model_a, b.model_dir AS model_b, round(CASE WHEN sqrt((a.v + b.v) / 2) > 0 THEN (a.mean - b.mean) / sqrt((a.v + b.v) / 2) ELSE 0 END, 6) AS d FROM m a JOIN m b ON a.model_dir < b.model_dir"


@query("length_stats", f"WITH {_LEN} {_STATS}")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.length_stats(pairs.lengths(documents(spark, sf_dir)))


@query("sentence_length_stats", f"WITH {_SENT} {_STATS}")
def sentence_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.length_stats(pairs.sentence_lengths(documents(spark, sf_dir)))


@query("length_cohens_d", f"WITH {_LEN}, {_D}")
def length_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cohens_d(pairs.moments(pairs.lengths(documents(spark, sf_dir))))


@query("sentence_length_cohens_d", f"WITH {_SENT}, {_D}")
def sentence_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cohens_d(pairs.moments(pairs.sentence_lengths(documents(spark, sf_dir))))


@query(
    "ks_statistic_pairs",
    f"WITH {_LEN}, top AS (SELECT model_dir, n AS token, count(*) AS c FROM val GROUP BY ALL), {_PAIRS}, g AS (SELECT *, abs(sum(x) OVER (PARTITION BY model_a, model_b ORDER BY token) / sum(x) OVER (PARTITION BY model_a, model_b) - sum(y) OVER (PARTITION BY model_a, model_b ORDER BY token) / sum(y) OVER (PARTITION BY model_a, model_b)) AS gap FROM al) "
    "SELECT model_a, model_b, round(max(gap), 6) AS ks, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM g GROUP BY ALL",
)
def ks_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.ks(pairs.lengths(documents(spark, sf_dir)))


_DELTA = f"""{_TOK}, sz AS (SELECT model_dir, count(*) AS n_m FROM txt GROUP BY ALL), mfw AS (SELECT token FROM (SELECT token, count(*) AS c, min({{'m': model_dir, 't': text_ord, 'p': pos}}) AS f FROM tok GROUP BY token) ORDER BY c DESC, f LIMIT 100),
ln AS (SELECT model_dir, text_ord, count(*) AS len FROM tok GROUP BY ALL), x AS (SELECT model_dir, text_ord, token, count(*) / CAST(any_value(len) AS DOUBLE) AS x FROM tok JOIN mfw USING (token) JOIN ln USING (model_dir, text_ord) GROUP BY ALL),
s AS (SELECT model_dir, token, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL), tot AS (SELECT CAST(sum(n_m) AS DOUBLE) AS n FROM sz),
f AS (SELECT token, sum(s) / n AS mu, sqrt((sum(q) - n * (sum(s) / n) * (sum(s) / n)) / (n - 1)) AS sg FROM s, tot GROUP BY token, n),
z AS (SELECT sz.model_dir, f.token, (coalesce(s.s, 0) / n_m - mu) / CASE WHEN sg > 0 THEN sg ELSE 1e-12 END AS z FROM sz CROSS JOIN f LEFT JOIN s ON s.model_dir = sz.model_dir AND s.token = f.token),
dl AS (SELECT a.model_dir AS model_a, b.model_dir AS model_b, round(avg(abs(a.z - b.z)), 6) AS burrows, round(1 - sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)), 6) AS cosine FROM z a JOIN z b ON a.token = b.token AND a.model_dir < b.model_dir GROUP BY ALL)"""


@query("burrows_cosine_global", f"WITH {_DELTA} SELECT * FROM dl")
def burrows_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.between(delta.centroids(documents(spark, sf_dir)))


@query(
    "burrows_pair_chunked",
    f"""WITH {_TOK}, st AS (SELECT model_dir, token, row_number() OVER (PARTITION BY model_dir ORDER BY topic, text_ord, pos) - 1 AS i, count(*) OVER (PARTITION BY model_dir) // 20 AS size FROM tok),
    pc AS (SELECT model_dir, token, size, CASE WHEN size > 0 THEN i // size ELSE 20 END AS chunk, count(*) AS c, min(i) AS i FROM st GROUP BY ALL), wd AS (SELECT model_dir, token, sum(c) AS c, min(i) AS i FROM pc GROUP BY ALL),
    m AS (SELECT DISTINCT model_dir FROM wd), pr AS (SELECT a.model_dir AS model_a, b.model_dir AS model_b FROM m a, m b WHERE a.model_dir < b.model_dir),
    bo AS (SELECT model_a, model_b, token, sum(c) AS c, min(f) AS f FROM (SELECT model_a, model_b, token, c, {{'s': 0, 'i': i}} AS f FROM wd JOIN pr ON model_dir = model_a UNION ALL SELECT model_a, model_b, token, c, {{'s': 1, 'i': i}} FROM wd JOIN pr ON model_dir = model_b) GROUP BY ALL),
    ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY c DESC, f) AS r FROM bo) WHERE r <= 100), su AS (SELECT model_dir, token, sum(c / CAST(size AS DOUBLE)) AS s, sum((c / CAST(size AS DOUBLE)) * (c / CAST(size AS DOUBLE))) AS q FROM pc WHERE chunk < 20 GROUP BY ALL),
    j AS (SELECT model_a, model_b, coalesce(a.s, 0) AS sa, coalesce(b.s, 0) AS sb, coalesce(a.q, 0) + coalesce(b.q, 0) AS q FROM ch LEFT JOIN su a ON a.model_dir = model_a AND a.token = ch.token LEFT JOIN su b ON b.model_dir = model_b AND b.token = ch.token),
    g AS (SELECT model_a, model_b, abs(sa - sb) / 20 AS d, sqrt(greatest(0, (q - 40 * ((sa + sb) / 40) * ((sa + sb) / 40)) / 39)) AS sg FROM j)
    SELECT model_a, model_b, round(avg(d / CASE WHEN sg > 0 THEN sg ELSE 1e-12 END), 6) AS burrows_chunked FROM g GROUP BY ALL""",
)
def burrows_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.chunked(documents(spark, sf_dir))


def _distances(texts: DataFrame, words: DataFrame, scope: str) -> DataFrame:
    """The long table (metric, scope, model_a, model_b, distance) of one scope's texts and the counts of their words.

    One part is finished before the next is begun, so that what it has moved can go.
    """
    d = settled(delta.between(delta.centroids(texts, words=words)), "deltas")
    long = lambda df, c, name: df.select(F.lit(name).alias("metric"), F.lit(scope).alias("scope"), "model_a", "model_b", F.col(c).alias("distance"))
    gap = lambda df, c, name: df.alias("a").join(df.alias("b"), F.col("a.model_dir") < F.col("b.model_dir")).select(F.lit(name).alias("metric"), F.lit(scope).alias("scope"), F.col("a.model_dir").alias("model_a"), F.col("b.model_dir").alias("model_b"), F.round(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), 6).alias("distance"))
    lex = lexical.profile_of(words)
    jsd = {n: settled(pairs.jsd(texts, n), f"jsd-{n}") for n in (2, 3)}
    mattr_ = settled(lexical.mattr(texts), "mattr")
    parts = [
        long(d, "burrows", "burrows_delta"), long(d, "cosine", "cosine_delta"), long(jsd[2], "jsd", "bigram_jsd"), long(jsd[3], "jsd", "trigram_jsd"),
        long(pairs.jaccard_of(words, pairs.pairs_of(texts)).withColumn("x", F.round(1 - F.col("jaccard"), 6)), "x", "jaccard_distance"),
        long(pairs.cohens_d(pairs.moments(pairs.lengths(texts))).withColumn("x", F.abs("d")), "x", "text_length_d"),
        long(pairs.cohens_d(pairs.moments(pairs.sentence_lengths(texts))).withColumn("x", F.abs("d")), "x", "sentence_length_d"),
        gap(lex, "ttr", "ttr"), gap(mattr_, "mattr", "mattr"), gap(lex, "hapax_ratio", "hapax_ratio"), gap(lex, "yules_k", "yules_k"), gap(lexical.zipf_of(words), "zipf", "zipf"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return settled(out, "distances")


def _distance_sql() -> str:
    """Each metric of each scope by itself; a scope's query reads only its topic's documents."""
    gap = lambda inner, c: f"SELECT a.model_dir AS model_a, b.model_dir AS model_b, round(abs(a.{c} - b.{c}), 6) AS distance FROM ({inner}) a JOIN ({inner}) b ON a.model_dir < b.model_dir"
    of = lambda inner, value: f"SELECT model_a, model_b, {value} AS distance FROM ({inner})"
    parts = {
        "burrows_delta": of(f"WITH {_DELTA} SELECT * FROM dl", "burrows"), "cosine_delta": of(f"WITH {_DELTA} SELECT * FROM dl", "cosine"), "bigram_jsd": of(SQL["jsd_bigram_pairs"], "jsd"), "trigram_jsd": of(SQL["jsd_trigram_pairs"], "jsd"),
        "jaccard_distance": of(SQL["jaccard_top100_pairs"], "round(1 - jaccard, 6)"), "text_length_d": of(SQL["length_cohens_d"], "abs(d)"), "sentence_length_d": of(SQL["sentence_length_cohens_d"], "abs(d)"),
    } | {name: gap(SQL[q], c) for name, q, c in (("ttr", "lexical_profile", "ttr"), ("mattr", "mattr", "mattr"), ("hapax_ratio", "lexical_profile", "hapax_ratio"), ("yules_k", "lexical_profile", "yules_k"), ("zipf", "zipf_exponent", "zipf"))}
    scopes = {"pooled": "FROM documents"} | {t: f"FROM (SELECT * FROM documents WHERE lang = '{t}')" for t in ("de", "en", "es", "fr")}
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, '{s}' AS scope, * FROM ({q.replace('FROM documents', source)})" for s, source in scopes.items() for m, q in parts.items())


@query("distance_long", _distance_sql())
def distance_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic by itself, and all pooled; a text without a topic is in the pooled scope only."""
    texts = documents(spark, sf_dir)
    words = lexical.words_by_topic(texts)
    pooled = written(words.groupBy("model_dir", "token").agg(F.sum("c").alias("c"), F.min("first").alias("first")), "words")
    out = _distances(texts, pooled, "pooled")
    dropped(pooled)
    for r in sorted(texts.where(F.col("topic").isNotNull()).select("topic").distinct().collect()):  # a list of topics is short
        own = F.col("topic") == r.topic
        out = out.unionByName(_distances(texts.where(own), words.where(own).drop("topic"), r.topic))
    dropped(words)
    return out


def _burrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burrows_global(spark, sf_dir).select("model_a", "model_b", F.col("burrows").alias("distance"))


_NAMES = [f"src{k}" for k in range(20)]
_CELLS = ", ".join(f"max(d) FILTER (b = '{n}') AS {n}" for n in _NAMES)


@query("distance_matrix_burrows", f"WITH {_DELTA}, u AS (SELECT model_a AS a, model_b AS b, burrows AS d FROM dl UNION ALL SELECT model_b, model_a, burrows FROM dl UNION ALL SELECT DISTINCT model_dir, model_dir, 0 FROM z) SELECT a AS model, {_CELLS} FROM u GROUP BY a")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.matrix(_known(_burrows(spark, sf_dir), "model_a", _NAMES), _NAMES)


@query("rank_to_target", f"WITH {_DELTA}, t AS (SELECT CASE WHEN model_a = 'src0' THEN model_b ELSE model_a END AS model, burrows AS distance FROM dl WHERE 'src0' IN (model_a, model_b)) SELECT model, distance, CAST(row_number() OVER (ORDER BY distance, model) AS INTEGER) AS rank FROM t")
def rank_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _burrows(spark, sf_dir).where((F.col("model_a") == "src0") | (F.col("model_b") == "src0"))
    return semantic.rank_by(near.select(F.when(F.col("model_a") == "src0", F.col("model_b")).otherwise(F.col("model_a")).alias("model"), "distance"), "distance")


@query("ref_lines", f"WITH {_DELTA} SELECT round(median(burrows), 6) AS median_distance, max(burrows) FILTER (model_a = 'src0' AND model_b = 'src1') AS bridge, count(*) AS n_pairs FROM dl")
def ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _burrows(spark, sf_dir)
    return d.agg(F.round(F.percentile("distance", F.lit(0.5)), 6).alias("median_distance"), F.max(F.when((F.col("model_a") == "src0") & (F.col("model_b") == "src1"), F.col("distance"))).alias("bridge"), F.count(F.lit(1)).alias("n_pairs"))


@query(
    "gap_vs_noise",
    f"WITH {_DELTA}, g AS (SELECT max(burrows) FILTER (model_a = 'src0' AND model_b = 'src2') AS gap1, max(burrows) FILTER (model_a = 'src1' AND model_b = 'src2') AS gap2, max(burrows) FILTER (model_a = 'src0' AND model_b = 'src1') AS noise FROM dl) SELECT gap1, gap2, noise, round(greatest(gap1, gap2) / nullif(noise, 0), 4) AS ratio FROM g",
)
def gap_vs_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda a, b: F.max(F.when((F.col("model_a") == a) & (F.col("model_b") == b), F.col("distance")))
    g = _burrows(spark, sf_dir).agg(pick("src0", "src2").alias("gap1"), pick("src1", "src2").alias("gap2"), pick("src0", "src1").alias("noise"))
    return g.withColumn("ratio", F.round(F.greatest("gap1", "gap2") / F.nullif("noise", F.lit(0.0)), 4))


@query("pair_fingerprint_verdict")
def pair_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, on = documents(spark, sf_dir), ["model_a", "model_b"]
    both = pairs.jaccard(texts).join(pairs.jsd(texts, 2), on).join(pairs.cohens_d(pairs.moments(pairs.lengths(texts))), on).join(delta.between(delta.centroids(texts)), on)
    sentences = pairs.ks_test(pairs.sentence_lengths(texts)).select(*on, F.col("ks").alias("sentence_ks"), F.col("ks_p").alias("sentence_ks_p"))
    both = both.join(pairs.ks_test(pairs.lengths(texts)), on).join(sentences, on, "left").join(delta.chunked(texts), on)
    return both.withColumn("warnings", pairs.verdict(F.col("jsd"), F.col("jaccard"), F.col("d"), F.col("burrows_chunked"), F.col("ks_p"), F.col("sentence_ks_p")))


@query("dedup_keep_first", "SELECT source AS model_dir, lang AS topic, min(doc_id) AS text_ord FROM documents GROUP BY source, lang, text")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_first(documents(spark, sf_dir)).select("model_dir", "topic", "text_ord")


@query(
    "repetition_loop_flags",
    f"WITH w AS (SELECT source AS model_dir, lang AS topic, doc_id AS text_ord, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z'']+') AS w FROM documents), g AS (SELECT text_ord, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM (SELECT *, unnest(range(greatest(len(w) - 2, 0))) AS p FROM w)), c AS (SELECT text_ord, g, count(*) AS c FROM g GROUP BY ALL), m AS (SELECT text_ord, max(c) AS top, sum(c) AS n FROM c GROUP BY ALL) "
    "SELECT w.model_dir, w.topic, w.text_ord, CAST(CASE WHEN coalesce(n, 0) >= 2 THEN top ELSE 0 END AS BIGINT) AS repetition_top_count, coalesce(n, 0) >= 2 AND top >= greatest(8, floor(0.015 * n)) AS flag_repetition_loop FROM w LEFT JOIN m USING (text_ord)",
)
def repetition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.repetition(documents(spark, sf_dir))


_BARE = r"regexp_replace(coalesce(text, ''), '\s+$', '')"
_TRUNCATED = rf"""({_BARE} = '' OR (NOT regexp_matches({_BARE}, '(?:[.!?…]|[.!?]["'')\]])$') AND len(regexp_extract_all({_BARE}, '[A-Za-z'']+')) >= {fixed.MAX_TOKENS / fixed.TOKENS_PER_WORD * fixed.TRUNCATION_SHARE}))"""


@query("truncation_flags", f"SELECT doc_id, {_TRUNCATED} AS truncated FROM documents")
def truncation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text")).alias("truncated"))


_FENCES = r"regexp_extract_all(coalesce(html, ''), '```[\s\S]*?```')"


@query(
    "code_html_contamination",
    rf"SELECT page_id, len({_FENCES}) AS code_fence_n, round(coalesce(list_sum(list_transform({_FENCES}, lambda x: length(x))), 0) / greatest(length(coalesce(html, '')), 1), 4) AS code_fence_ratio, regexp_matches(coalesce(html, ''), '<(?:[a-zA-Z]+|/[a-zA-Z]+)\b[^<>]{{0,200}}>') AS has_html FROM pages",
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(X.fences(html)).cast("long").alias("code_fence_n"), X.fence_share(html).alias("code_fence_ratio"), X.has_html(html).alias("has_html"))


def _literals(rows: list[tuple], quote: str = "''") -> str:
    """Rows for VALUES; quote is how the engine writes a quote inside a text."""
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", quote) + "'" for v in r) + ")" for r in rows)


_OPENERS = [
    (1, "As an AI language model, I might perhaps say it could rain."), (2, "I don't have personal opinions about this."), (3, "I'm sorry, but I can't help with that."), (4, "A plain text about the weather."),
    (5, "I cannot form beliefs."), (6, "My opinions are mine alone."), (7, "I should clarify one thing first."), (8, "Speaking as an AI, no."), (9, None), (10, ""), (11, "x" * 250 + " As an AI, late"), (12, "I must decline."),
    (13, "I appreciate your question, which seems to suggest that it may possibly be so."), (14, "From the perspective of a chatbot"), (15, "As a machine shop owner, I weld."),
]


def _opener_case(label: str) -> str:
    return "regexp_matches(coalesce(substr(text, 1, 250), ''), '(?i)(?:" + "|".join(fixed.OPENERS[label]).replace("'", "''") + ")')"


@query(
    "opener_flags",
    f"SELECT id, {', '.join(f'{_opener_case(k)} AS {k}' for k in fixed.OPENERS)}, len(list_filter(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 250)), '[A-Za-z'']+'), lambda w: w IN ({', '.join(repr(h) for h in fixed.OPENER_HEDGES)}))) AS hedges FROM (VALUES {_literals(_OPENERS)}) t(id, text)",
)
def opener_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES " + _literals(_OPENERS, "\\'") + " AS t(id, text)")
    return rows.select("id", *(X.opener(F.col("text"), k).alias(k) for k in fixed.OPENERS), X.opener_hedges(F.col("text")).alias("hedges"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaned(documents(spark, sf_dir))


@query("quality_clean")
def quality_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.quality(_flagged(spark, sf_dir)).drop("text", "text_clean")


@query("quality_summary")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.summary(_flagged(spark, sf_dir))


_LANGS = ["de", "en", "es", "fr"]


def _known(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows; a matrix has fixed columns, so a name that has none (null too) fails the query instead of being left out."""
    return rows.where(F.when(F.coalesce(F.col(column).isin(names), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{column} without a column: "), F.coalesce(column, F.lit("null")))).cast("boolean")))


@query("flag_rate_matrix", f"SELECT source AS model_dir, {', '.join(f'round(avg(CASE WHEN {_TRUNCATED} THEN 1.0::DOUBLE ELSE 0 END) FILTER (lang = {l!r}) * 100, 4) AS {l}' for l in _LANGS)} FROM documents GROUP BY source")
def flag_rate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.flag_rates(_known(documents(spark, sf_dir), "topic", _LANGS).withColumn("flag_truncation", X.truncated(F.col("text"))), "flag_truncation", _LANGS)


@query("verbosity_matrix", f"SELECT source AS model_dir, {', '.join(f'round(median({_WORDS}) FILTER (lang = {l!r}), 4) AS {l}' for l in _LANGS)} FROM documents GROUP BY source")
def verbosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(documents(spark, sf_dir), "topic", _LANGS).withColumn("n", X.word_count(F.col("text")))
    return rows.groupBy("model_dir").pivot("topic", _LANGS).agg(F.round(F.percentile("n", F.lit(0.5)), 4))


def _feature_sql(pattern: str) -> str:
    flags, p = ("(?i)", pattern.removeprefix("(?iu)")) if pattern.startswith("(?iu)") else ("", pattern)
    return f"len(regexp_extract_all(coalesce(text, ''), '{flags}{p}'))"


_FEATURES = X.discourse_features()
_COUNTED = ", ".join(f"sum({_feature_sql(p)}) AS f{k}" for k, (_, p) in enumerate(_FEATURES.values()))
_STACK = " UNION ALL ".join(f"SELECT model_dir, scope, '{c}' AS category, '{n}' AS feature, CAST(f{k} AS BIGINT) AS count, CAST(words AS BIGINT) AS words, round(1000 * CAST(f{k} AS DOUBLE) / words, 4) AS rate FROM s WHERE words > 0" for k, (n, (c, _)) in enumerate(_FEATURES.items()))
_DISCOURSE = f"s AS (SELECT source AS model_dir, CASE WHEN grouping(lang) = 1 THEN 'pooled' ELSE lang END AS scope, sum({_WORDS}) AS words, {_COUNTED} FROM documents GROUP BY GROUPING SETS ((source, lang), (source))), d AS ({_STACK})"


@query("discourse_rates", f"WITH {_DISCOURSE} SELECT * FROM d")
def discourse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.rates(documents(spark, sf_dir))


@query("discourse_matrix", f"WITH {_DISCOURSE} SELECT model_dir, {', '.join(f'max(rate) FILTER (feature = {n!r}) AS {n}' for n in fixed.PUNCTUATION)} FROM d WHERE scope = 'pooled' GROUP BY model_dir")
def discourse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.category_matrix(discourse.rates(documents(spark, sf_dir)), "punctuation")


def _keyness_sql(counts: str, by: str = "") -> str:
    own, p = (f"{by}, " if by else ""), (f"PARTITION BY {by}" if by else "")
    return f"""k0 AS (SELECT *, CAST(c AS DOUBLE) AS c1, CAST(sum(c) OVER (PARTITION BY {own}token) - c AS DOUBLE) AS c2, CAST(sum(c) OVER (PARTITION BY {own}model_dir) AS DOUBLE) AS n1, CAST(sum(c) OVER ({p}) AS DOUBLE) AS al FROM {counts}),
    k1 AS (SELECT *, al - n1 AS n2, (c1 + c2) / al AS e FROM k0 WHERE c1 >= 5),
    k2 AS (SELECT *, 2 * (c1 * ln(c1 / (n1 * e)) + CASE WHEN c2 > 0 THEN c2 * ln(c2 / (n2 * e)) ELSE 0 END) AS g2, round(log2(((c1 + 0.5::DOUBLE) / n1) / ((c2 + 0.5::DOUBLE) / n2)), 6) AS log_ratio FROM k1),
    k3 AS (SELECT *, row_number() OVER (PARTITION BY {own}model_dir ORDER BY log_ratio DESC, f) AS rank FROM k2 WHERE g2 >= {fixed.G2_LEAST})"""


@query("keyness_topn", f"WITH {_CNT}, {_keyness_sql('cnt')} SELECT model_dir, CAST(rank AS INTEGER) AS rank, token, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, round(g2, 4) AS g2, log_ratio FROM k3 WHERE rank <= 20")
def keyness_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyness.topn(documents(spark, sf_dir))


def _draw_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


@query(
    "keyness_consensus",
    f"WITH {_TOK}, rp AS (SELECT model_dir, text_ord, unnest(range(50)) AS rep FROM txt), rr AS (SELECT *, row_number() OVER (PARTITION BY rep, model_dir ORDER BY {_draw_sql(chr(39) + 'keyness' + chr(39), 'rep', 'model_dir', 'text_ord')}, text_ord) AS r, count(*) OVER (PARTITION BY rep, model_dir) AS n FROM rp), "
    "pc AS (SELECT model_dir, text_ord, token, count(*) AS c, min(pos) AS pos FROM tok GROUP BY ALL), w AS (SELECT model_dir, token, CAST(sum(c) AS DOUBLE) AS c, min({'t': text_ord, 'p': pos}) AS f FROM pc GROUP BY ALL), "
    "smp AS (SELECT rep, pc.model_dir, token, CAST(sum(c) AS DOUBLE) AS c1 FROM rr JOIN pc USING (model_dir, text_ord) WHERE n >= 4 AND r <= greatest(2, n // 2) GROUP BY ALL UNION ALL SELECT -1, model_dir, token, c FROM w WHERE model_dir IN (SELECT model_dir FROM rr WHERE n >= 4)), "
    "z AS (SELECT smp.*, sum(c1) OVER (PARTITION BY rep, model_dir) AS n1 FROM smp), rest AS (SELECT model_dir, token, f, sum(c) OVER (PARTITION BY token) - c AS c2, sum(c) OVER () - sum(c) OVER (PARTITION BY model_dir) AS n2 FROM w), "
    "k1 AS (SELECT z.*, f, c2, n2, (c1 + c2) / (n1 + n2) AS e FROM z JOIN rest USING (model_dir, token) WHERE c1 >= 20 AND n2 > 0), "
    "k2 AS (SELECT *, 2 * (c1 * ln(c1 / (n1 * e)) + CASE WHEN c2 > 0 THEN c2 * ln(c2 / (n2 * e)) ELSE 0 END) AS g2, round(log2(((c1 + 0.5::DOUBLE) / n1) / ((c2 + 0.5::DOUBLE) / n2)), 6) AS log_ratio FROM k1), "
    f"k3 AS (SELECT *, row_number() OVER (PARTITION BY rep, model_dir ORDER BY log_ratio DESC, f) AS rank FROM k2 WHERE g2 >= {fixed.G2_LEAST}), "
    "v AS (SELECT model_dir, token, round(count(*) FILTER (rep >= 0) / 50.0::DOUBLE, 4) AS selection_rate, min(rep) = -1 AS point FROM k3 WHERE rank <= 20 GROUP BY ALL) SELECT *, point AND selection_rate >= 0.8 AS consensus FROM v",
)
def keyness_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyness.consensus(documents(spark, sf_dir))


_SUMMARY = "count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS p2_5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.975), 6) AS p97_5"


@query(
    "bootstrap_ttr_ci",
    f"WITH {_TOK}, r AS (SELECT model_dir, text_ord, row_number() OVER (PARTITION BY model_dir ORDER BY text_ord) - 1 AS i, count(*) OVER (PARTITION BY model_dir) AS n FROM txt), d AS (SELECT model_dir, n, i AS d, unnest(range(1000)) AS rep FROM r), "
    f"pk AS (SELECT model_dir, rep, {_draw_sql(chr(39) + 'boot' + chr(39), 'rep', 'model_dir', 'd')} % n AS i, count(*) AS w FROM d GROUP BY ALL), pc AS (SELECT model_dir, text_ord, token, count(*) AS c FROM tok GROUP BY ALL), "
    "dr AS (SELECT model_dir, text_ord, CAST(rep AS INTEGER) AS rep, w FROM pk JOIN r USING (model_dir, i)), mk AS (SELECT model_dir, text_ord, bitstring_agg(rep, 0, 999) AS m FROM dr GROUP BY ALL), ty AS (SELECT model_dir, bit_or(m) AS m FROM pc JOIN mk USING (model_dir, text_ord) GROUP BY model_dir, token), "
    "ln AS (SELECT model_dir, text_ord, sum(c) AS n FROM pc GROUP BY ALL), nt AS (SELECT model_dir, rep, sum(w * n) AS n FROM dr JOIN ln USING (model_dir, text_ord) GROUP BY ALL), vt AS (SELECT model_dir, rep, sum(get_bit(m, rep)) AS v FROM ty, (SELECT CAST(unnest(range(1000)) AS INTEGER) AS rep) GROUP BY ALL), val AS (SELECT model_dir, v / CAST(n AS DOUBLE) AS v FROM vt JOIN nt USING (model_dir, rep)), "
    f"pt AS (SELECT model_dir, round(count(DISTINCT token) / CAST(count(*) AS DOUBLE), 6) AS point FROM tok GROUP BY ALL) SELECT model_dir, {_SUMMARY}, any_value(point) AS point FROM val JOIN pt USING (model_dir) GROUP BY model_dir",
)
def bootstrap_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_ttr(documents(spark, sf_dir))


#: Keywords that the driver's invented languages can hold, besides the real ones.
KEYS = fixed.KEYWORDS | {"invented_a": ["the th", "tion", "ention"], "invented_b": ["que ", "ción", "re the"]}
_KEYS = ", ".join(f"('{t}', '{k}')" for t, ks in KEYS.items() for k in ks)
_HITS = f"kw(topic, keyword) AS (VALUES {_KEYS}), hits AS (SELECT doc_id, topic, keyword FROM documents, kw WHERE contains(lower(text), keyword))"


@query("keyword_topic_match", f"WITH {_HITS} SELECT * FROM hits")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.keyword_hits(table(spark, sf_dir, "documents"), KEYS)


@query("keyword_counts", f"WITH {_HITS} SELECT kw.topic, kw.keyword, count(doc_id) AS n FROM kw LEFT JOIN hits ON hits.topic = kw.topic AND hits.keyword = kw.keyword GROUP BY ALL")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.topic_counts(keyword_match(spark, sf_dir), KEYS)


@query("topic_overlap", f"WITH {_HITS}, d AS (SELECT DISTINCT doc_id, topic FROM hits) SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS n FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY ALL")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.topic_overlap(keyword_match(spark, sf_dir))


@query("author_pseudonym", "SELECT conv_id, turn, substr(sha256('corpus' || chr(0) || CAST(conv_id AS VARCHAR) || ':' || role), 1, 16) AS author_id FROM conversations")
def author_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.pseudonym(name, "corpus").alias("author_id"))


@query("content_manifest", f"SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha256(substr(coalesce(text, ''), 1, 300)) AS prefix_sha256, {_WORDS} AS n_words FROM documents")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.manifest(table(spark, sf_dir, "documents"))


@query("word_threshold_counts", f"SELECT source, count(*) AS n, {', '.join(f'count(*) FILTER ({_WORDS} >= {s}) AS n_{s}' for s in (50, 100, 200, 400))} FROM documents GROUP BY source")
def word_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.thresholds(table(spark, sf_dir, "documents"), "source")


@query("length_quantiles", f"SELECT source, {', '.join(f'round(quantile_cont({_WORDS}::DOUBLE, {p}), 6) AS q{int(p * 100)}' for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0))} FROM documents GROUP BY source")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.quantiles(table(spark, sf_dir, "documents"), "source")


@query("word_window", f"SELECT doc_id FROM documents WHERE {_WORDS} BETWEEN 100 AND 2000")
def word_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(human.word_window(F.col("text"))).select("doc_id")


@query(
    "embedding_redundancy",
    "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT label, max(n) AS n, round(1 - sqrt(sum(s * s)) / max(n), 6) AS spread, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s GROUP BY label",
)
def embedding_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.redundancy(table(spark, sf_dir, "embeddings"), "label")


@query(
    "ngram_perplexity",
    f"WITH {_TOK}, w AS (SELECT model_dir, text_ord, token, count(*) AS c FROM tok GROUP BY ALL), m AS (SELECT token, sum(c) AS k FROM w GROUP BY ALL), t AS (SELECT CAST(sum(k) AS DOUBLE) AS n, count(*) AS v FROM m), p AS (SELECT model_dir, text_ord, sum(c) AS nt, sum(c * -ln((k + 1) / (n + v))) / sum(c) AS nll FROM w JOIN m USING (token), t GROUP BY ALL) "
    "SELECT model_dir, count(*) AS n_texts, CAST(sum(nt) AS BIGINT) AS n_tokens, round(avg(nll), 6) AS mean_nll, round(median(exp(least(nll, 50))), 4) AS median_ppl, round(avg(exp(least(nll, 50))), 4) AS mean_ppl, round(stddev_samp(exp(least(nll, 50))), 4) AS std_ppl FROM p GROUP BY model_dir",
)
def ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.perplexity(documents(spark, sf_dir))


# Two hand-parsed texts: "The cat was seen by dogs . It ran because it was late ." and "Birds that sing fly ."
_PARSED = [
    ("a", "t", 1, 0, 0, 1, "DET", "det", False, False, 0), ("a", "t", 1, 0, 1, 3, "NOUN", "nsubjpass", False, False, 0), ("a", "t", 1, 0, 2, 3, "AUX", "auxpass", False, False, None), ("a", "t", 1, 0, 3, 3, "VERB", "ROOT", False, True, None),
    ("a", "t", 1, 0, 4, 3, "ADP", "agent", False, False, None), ("a", "t", 1, 0, 5, 4, "NOUN", "pobj", False, False, 1), ("a", "t", 1, 0, 6, 3, "PUNCT", "punct", False, False, None),
    ("a", "t", 1, 1, 7, 8, "PRON", "nsubj", False, False, 2), ("a", "t", 1, 1, 8, 8, "VERB", "ROOT", False, False, None), ("a", "t", 1, 1, 9, 11, "SCONJ", "mark", False, False, None), ("a", "t", 1, 1, 10, 11, "PRON", "nsubj", False, False, 3),
    ("a", "t", 1, 1, 11, 8, "AUX", "advcl", False, False, None), ("a", "t", 1, 1, 12, 11, "ADJ", "acomp", False, False, None), ("a", "t", 1, 1, 13, 8, "PUNCT", "punct", False, False, None),
    ("b", "t", 2, 0, 0, 3, "NOUN", "nsubj", False, False, 0), ("b", "t", 2, 0, 1, 2, "PRON", "nsubj", False, False, None), ("b", "t", 2, 0, 2, 0, "VERB", "relcl", False, False, None), ("b", "t", 2, 0, 3, 3, "VERB", "ROOT", False, False, None), ("b", "t", 2, 0, 4, 3, "PUNCT", "punct", False, False, None),
    ("b", "t", 3, 0, 0, 0, "PUNCT", "punct", False, False, None), ("b", "t", 3, 0, 1, 0, "SPACE", "dep", True, False, None),
]
_COLUMNS = "model_dir, topic, text_ord, sent_id, i, head_i, pos, dep, is_space, voice_passive, chunk_id"
_PARSED_SQL = f"parsed({_COLUMNS}) AS (VALUES {_literals(_PARSED)})"


def parsed_example(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_literals(_PARSED)} AS t({_COLUMNS})")


_DEPTH = "up AS (SELECT model_dir, text_ord, sent_id, i, i AS at, 0 AS d FROM parsed WHERE NOT is_space UNION ALL SELECT u.model_dir, u.text_ord, u.sent_id, u.i, p.head_i, u.d + 1 FROM up u JOIN parsed p ON p.model_dir = u.model_dir AND p.text_ord = u.text_ord AND p.i = u.at WHERE p.head_i <> p.i), dp AS (SELECT model_dir, text_ord, i, max(d) AS depth FROM up GROUP BY ALL)"


@query("syntax_dep_labels", f"WITH {_PARSED_SQL}, e AS (SELECT model_dir, dep, abs(i - head_i) AS dl FROM parsed WHERE NOT is_space AND dep <> 'punct' AND head_i <> i) SELECT model_dir, dep, count(*) AS n, round(1000 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY model_dir) AS DOUBLE), 4) AS per_1k_edges, round(avg(dl), 6) AS mean_dl FROM e GROUP BY model_dir, dep")
def syntax_dep_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.dep_labels(parsed_example(spark))


@query(
    "syntax_by_length",
    f"WITH RECURSIVE {_PARSED_SQL}, {_DEPTH}, s AS (SELECT p.model_dir, p.text_ord, p.sent_id, count(*) AS e, avg(abs(p.i - head_i)) AS dl, avg(depth) AS h FROM parsed p JOIN dp ON dp.model_dir = p.model_dir AND dp.text_ord = p.text_ord AND dp.i = p.i WHERE NOT is_space AND dep <> 'punct' AND head_i <> p.i GROUP BY ALL) SELECT model_dir, CAST(least(e, 80) AS BIGINT) AS length, count(*) AS n_sents, round(avg(dl), 9) AS mean_dl, round(avg(h), 9) AS mean_mhd FROM s GROUP BY ALL",
)
def syntax_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.by_length(parsed_example(spark))


@query("syntax_per_text")
def syntax_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.per_text(parsed_example(spark))


@query("pos_jsd", f"WITH {_PARSED_SQL}, top AS (SELECT model_dir, pos AS token, count(*) AS c FROM parsed WHERE NOT is_space GROUP BY ALL), {_PAIRS}, {_JSD} SELECT * FROM js")
def pos_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.jsd_of(syntax.pos_grams(parsed_example(spark), 1))


@query("upgma_merge_table")
def upgma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.upgma(_burrows(spark, sf_dir))


@query("mds_2d")
def mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mds(_burrows(spark, sf_dir))


@query("pca_2d")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.pca(table(spark, sf_dir, "embeddings"), "vec_id")


@query("value_stats_by_event", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


from . import surveys  # noqa: E402, F401  (registers the rest of the queries)
