"""Queries held against their SQL on small tables with what larger ones hold."""

import duckdb
import pytest

from corpuscle.plans import catalogue


def same(spark, path, name):
    """The query's rows and those of its SQL, in one order."""
    got = catalogue.QUERIES[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    found = con.execute(catalogue.SQL[name])
    names, key = [d[0] for d in found.description], lambda r: [(x is None, f"{x:.9g}" if isinstance(x, float) else str(x)) for x in r]
    want = sorted(map(key, found.fetchall()))
    assert sorted(key([r[n] for n in names]) for r in got.collect()) == want
    assert want
    return True


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    return path


ENDS = [" space", "space ", "\n\nline", "line\n", "\ttab\t", "return\r", "a\r\nb", '"quoted"', '"', "back\\", "\x01", "   ", " x, \"y\" ", "null", "plain words"]


@pytest.mark.parametrize("name", ["corpora_round_trip", "cleaned_round_trip"])
def test_round_trips_keep_every_character(spark, tmp_path, name):
    rows = [(k, t, ("de", None)[k % 3 == 2], f"src{k % 2}") for k, t in enumerate(ENDS)]
    assert same(spark, write(spark, tmp_path, rows), name)


def test_texts_by_author_keep_every_character(spark, tmp_path):
    assert same(spark, write(spark, tmp_path, [(k, t, "de", f"src{k % 2}") for k, t in enumerate(ENDS) if t.strip()]), "texts_by_author")


TALK = [(k, f"Word{k} runs quickly. It said, well, that it was {'very ' * k}late! Was it?", "de", f"src{k % 2}") for k in range(40)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["dl_by_length", "clause_medians", "syntax_per_text_documents"])
def test_sentences_are_not_brought_together_again(spark, tmp_path, name):
    path = write(spark, tmp_path, TALK)
    assert "collect_list" not in plan(catalogue.QUERIES[name](spark, str(path)))
    assert same(spark, path, name)


def test_depth_is_the_same_either_way(spark):
    from corpuscle.operators import syntax

    texts = spark.createDataFrame([(m, t, k, s) for k, s, t, m in TALK], "model_dir string, topic string, text_ord long, text string")
    want = {(r.text_ord, r.i): (r.depth, r.dl) for r in syntax.with_depth(syntax.annotate(texts)).collect()}
    assert {(r.text_ord, r.i): (r.depth, r.dl) for r in syntax.with_depth(syntax.annotate(texts, True)).collect()} == want


def test_tags_by_text_count_as_those_by_token(spark):
    from corpuscle.operators import syntax

    texts = spark.createDataFrame([(m, t, k, s) for k, s, t, m in [*TALK, (99, None, "de", "src0"), (98, "one", "de", "src0")]], "model_dir string, topic string, text_ord long, text string")
    for n in (1, 2, 3):
        assert sorted(syntax.tag_grams(syntax.tags_of(texts), n).collect()) == sorted(syntax.pos_grams(syntax.annotate(texts), n).collect())


def test_parsed_tokens_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    from corpuscle.operators import syntax
    from corpuscle.sources import readers

    from pyspark.sql import DataFrameWriter

    texts = spark.createDataFrame([(m, t, k, s) for k, s, t, m in TALK], "model_dir string, topic string, text_ord long, text string")
    seen, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")), plain(*a, **k)))
    readers.write_parsed(syntax.annotate(texts), str(tmp_path / "p"))
    assert seen == ["64"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert readers.read_parsed(spark, str(tmp_path / "p")).count() == syntax.annotate(texts).count()


LOOPS = [(k, t, ("de", None)[k % 4 == 3], f"src{k // 2 % 2}") for k, t in enumerate(["a b c " * 30, "a b c " * 30, None, None, "", "one", "one two", "one two three", "one two three", "it's it's it's it's it's", "x " * 40, "x " * 40])]


def test_loops_and_copies_move_no_text(spark, tmp_path):
    path = write(spark, tmp_path, LOOPS)
    assert same(spark, path, "repetition_loop_flags") and same(spark, path, "dedup_keep_first")
    for name in ("repetition_loop_flags", "quality_clean"):
        assert not {"Aggregate", "Window", "Generate"} & {line.split("[")[0].split(" ")[-1] for line in plan(catalogue.QUERIES[name](spark, str(path)).coalesce(1)).splitlines()}
        assert "Window" not in plan(catalogue.QUERIES[name](spark, str(path)))


def test_counts_within_a_text(spark):
    from pyspark.sql import functions as F

    from corpuscle.functions import text as X

    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (None,)], "w array<string>")
    got = [[tuple(x) for x in r.c] if r.c else None for r in rows.select(X.counted(F.col("w")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 2)], None, [("x", 1)], None]
    assert [r.g for r in rows.select(X.grams(F.col("w"), 2).alias("g")).collect()][:3] == [["b a", "a b"], [], []]


def test_top_lists_rank_few_counts(spark, tmp_path):
    path = write(spark, tmp_path, LOOPS)
    for name in ("top_bigrams", "top_trigrams", "top_words"):
        assert same(spark, path, name)
        assert "sum(c" not in plan(catalogue.QUERIES[name](spark, str(path)))


def test_delta_counts_in_the_text(spark, tmp_path):
    path = write(spark, tmp_path, TALK)
    assert same(spark, path, "burrows_cosine_global")
    from corpuscle.operators import delta
    from corpuscle.sources.readers import documents

    texts = documents(spark, str(path))
    assert "Aggregate" not in plan(delta.per_text(texts, spark.createDataFrame([("it",)], "token string")))


def test_streams_count_frequent_words_only_where_that_suffices(spark, monkeypatch):
    import random

    from corpuscle.operators import delta, resample

    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(f"m{k % 2}", "t", k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=200))) for k in range(24)]
    texts = spark.createDataFrame(rows, "model_dir string, topic string, text_ord long, text string").withColumn("author_id", X_who())
    asked, suffices = [], delta._suffices
    monkeypatch.setattr(delta, "_suffices", lambda *a: (asked.append(suffices(*a)), asked[-1])[1])
    key = lambda head: (monkeypatch.setattr(delta, "HEAD", head), sorted(map(str, resample.author_deltas(texts, "author_id", splits=1, pool_splits=1).collect())))[1]
    want = key(400)  # every word
    assert key(1) == want and asked == [True, False]  # a hundred are too few to be sure: all are counted then


def X_who():
    from pyspark.sql import functions as F

    return F.col("model_dir")
