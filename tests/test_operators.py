"""Operators on hand-made inputs: edge cases, and properties of the metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import clean, delta, geometry, human, lexical, pairs, resample, semantic
from corpuscle.sources import readers
from corpuscle.streaming import counts as streaming

TEXTS = "model_dir string, topic string, text_ord long, text string"


def texts_of(spark, rows):
    return spark.createDataFrame(rows, TEXTS)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Don't e-mail", ["don", "t", "e", "mail"]), ("a b", ["a", "b"]), ("ÉTÉ été", ["été", "été"]), ("?!", []), ("", []), (None, [])],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens, text) == want


def test_sentences(spark):
    assert one(spark, X.sentences, " Dr. Smith came?! Yes.\nNo stop ") == ["Dr.", "Smith came?!", "Yes.", "No stop"]


@pytest.mark.parametrize(("text", "want"), [("", True), ("  ", True), (None, True), ("w " * 1483, False), ("w " * 1484, True), ("w " * 1484 + "end.", False), ("w " * 1484 + 'end."', False), ("w " * 1484 + "end…  ", False)])
def test_truncation(spark, text, want):
    assert one(spark, X.truncated, text) is want


def test_fences_and_html(spark):
    assert one(spark, X.without_fences, "a ```x\ny``` b") == "a [CODE_BLOCK] b"
    assert [one(spark, X.has_html, t) for t in ("a < b", "<b>", "</p>", "<p " + "x" * 201 + ">")] == [False, True, True, False]


def test_unescape_and_normalise(spark):
    assert one(spark, X.unescape, "a &amp; b") == "a & b"
    assert one(spark, X.normalised, " a\r\nb\n\n\n\nc ") == "a\nb\n\nc"


def test_repetition(spark):
    loop = "one two three " * 8
    found = {r.text_ord: r for r in clean.repetition(texts_of(spark, [("m", "t", 1, loop), ("m", "t", 2, "one two three " * 7), ("m", "t", 3, "a b c"), ("m", "t", 4, None)])).collect()}
    assert [found[k].flag_repetition_loop for k in (1, 2, 3, 4)] == [True, False, False, False] and found[1].repetition_top_count == 8 and found[3].repetition_top_count == 0


def test_keep_first(spark):
    got = clean.keep_first(texts_of(spark, [("m", "t", 1, "a"), ("m", "t", 2, "a"), ("m", "u", 3, "a"), ("m", "t", 4, None), ("m", "t", 5, None)]))
    assert sorted(r.text_ord for r in got.collect()) == [1, 3, 4]


def test_null_flag_drops_row(spark):
    table = spark.createDataFrame([(1, None, False), (2, False, False), (3, True, False)], "id int, flag_repetition_loop boolean, flag_code_contam boolean")
    assert [r.id for r in clean.quality(table, ("flag_repetition_loop", "flag_code_contam")).collect()] == [2]


@pytest.mark.parametrize("window", [3, 7, 500])
def test_mattr_is_the_naive_mean(spark, window):
    rng = random.Random(window)
    words = [rng.choice("abcdef") for _ in range(60)]
    rows = [("m", "t", k, " ".join(words[10 * k : 10 * k + 10])) for k in range(6)]
    got = lexical.mattr(texts_of(spark, rows), window).first().mattr
    w = min(window, 60)
    assert got == pytest.approx(np.mean([len(set(words[k : k + w])) / w for k in range(60 - w + 1)]), abs=1e-6)


def test_top_ties_go_to_the_first_seen(spark):
    got = lexical.top(lexical.tokens_of(texts_of(spark, [("m", "t", 1, "b a c"), ("m", "t", 2, "a b")])), 2, "model_dir").orderBy("rank").collect()
    assert [r.token for r in got] == ["b", "a"]


def test_distances_of_equal_and_disjoint(spark):
    same = "alpha beta gamma delta"
    texts = texts_of(spark, [("a", "t", 1, same), ("b", "t", 2, same), ("c", "t", 3, "one two three four")])
    jsd = {(r.model_a, r.model_b): r.jsd for r in pairs.jsd(texts, 2).collect()}
    assert jsd["a", "b"] == 0 and jsd["a", "c"] == pytest.approx(1, abs=1e-6)
    jac = {(r.model_a, r.model_b): r.jaccard for r in pairs.jaccard(texts).collect()}
    assert jac == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert {r.d for r in pairs.cohens_d(pairs.moments(pairs.lengths(texts.unionAll(texts)))).collect()} == {0.0}


def test_global_delta_ignores_order_of_texts(spark):
    rng = random.Random(3)
    rows = [(m, "t", k, " ".join(rng.choice("abcdefgh") for _ in range(20))) for m in "xy" for k in range(8)] + [("x", "t", 99, "")]
    flipped = [(m, t, 1000 - k, s) for m, t, k, s in rows]
    a, b = (delta.between(delta.centroids(texts_of(spark, r), 5)).first() for r in (rows, flipped))
    assert a.burrows == pytest.approx(b.burrows, abs=1e-6)


def test_ks(spark):
    values = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", v) for v in (3, 4, 5, 6)], "model_dir string, n long")
    row = pairs.ks(values).withColumn("p", pairs.ks_p(F.col("ks"), F.col("n_a").cast("double"), F.col("n_b").cast("double"))).first()
    assert row.ks == 0.5 and 0 < row.p <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_exclusive_quartiles(spark, n):
    import statistics

    values = [float(v * v) for v in range(n)]
    row = resample.exclusive_quartiles(spark.createDataFrame([("m", v) for v in values], "model_dir string, v double"), "model_dir").first()
    want = [pytest.approx(v, abs=1e-5) for v in statistics.quantiles(values, n=4)] if n >= 4 else [values[0], statistics.median(values), values[-1]]  # so few: least, median, most
    assert [row.p25, row.median, row.p75] == want and row.std == pytest.approx(statistics.pstdev(values), abs=1e-5)


def test_bootstrap_draws_as_many_as_there_are(spark):
    texts = texts_of(spark, [("m", "t", k, "a") for k in range(25)])
    totals = resample.bootstrap_weights(texts, 5, "s").groupBy("rep").agg(F.sum("w").alias("w")).collect()
    assert [r.w for r in totals] == [25] * 5


def test_usable_posts(spark):
    rows = [("a", "body", "1", "ChangeMyView"), (None, "body", "2", ""), ("[deleted]", "b", "3", ""), ("DeltaBot", "b", "4", ""), ("a", "[removed]", "5", ""), ("a", "b", None, ""), ("a", "b", "7", "pics"), ("a", "b", "8", None)]
    posts = spark.createDataFrame(rows, "author string, body string, id string, forum string")
    kept = posts.where(human.usable(F.col("author"), F.col("body"), F.col("id"), F.col("forum")))
    assert sorted(r.id for r in kept.collect()) == ["1", "8"]


def test_dedup_posts(spark):
    rows = [(1, "x", "ann", "t" * 300 + "a"), (2, "x", "bob", "u"), (3, "y", "ann", "t" * 300 + "b"), (4, "z", "bob", "t" * 300)]
    posts = spark.createDataFrame(rows, "text_ord long, id string, author string, text string")
    assert sorted(r.text_ord for r in human.dedup_posts(posts, "id", "author", "text").collect()) == [1, 4]


def test_redundancy_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row = semantic.redundancy(spark.createDataFrame([(1, v.tolist()) for v in x] + [(1, None)], "label int, embedding array<double>"), "label").first()
    pair = (x @ x.T)[np.triu_indices(12, 1)].mean()
    assert row.n == 12 and row.mean_cosine == pytest.approx(pair, abs=1e-5) and row.spread == pytest.approx(1 - np.linalg.norm(x.mean(0)), abs=1e-5)


def test_geometry(spark):
    at = {"a": 0.0, "b": 1.0, "c": 5.0, "d": 7.0}
    rows = [(m, n, abs(at[m] - at[n])) for m in at for n in at if m < n]
    table = spark.createDataFrame(rows, "model_a string, model_b string, distance double")
    merges = geometry.upgma(table).orderBy("step").collect()
    assert [(r.left, r.right, r.height, r.size) for r in merges] == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 5.5, 4)]
    where = {r.model: r.x for r in geometry.mds(table).collect()}
    assert all(math.isclose(abs(where[m] - where[n]), abs(at[m] - at[n]), abs_tol=1e-6) for m in at for n in at)
    wide = pairs.matrix(table, list(at)).orderBy("model").collect()
    assert wide[0].a == 0 and wide[0].d == wide[3].a == 7


def test_csv_corpora(spark, tmp_path):
    for folder, body in (("run1/climate", 'topic,model,text,language\nclimate,m,"two\nlines, ""quoted""",en\nclimate,m,,en\n'), ("smoke_x/climate", "topic,model,text,language\nclimate,m,no,en\n"), ("phase0_a/climate", "topic,model,text,language\nclimate,m,old,en\n")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "My Model.csv").write_text(body)
    schema = readers.T.StructType(readers.RAW.fields[:4])
    got = readers.read_corpora(spark, [str(p) for p in tmp_path.glob("*/*/*.csv")], schema).collect()
    assert sorted((r.model_dir, r.text) for r in got) == [("phase0_my-model", "old"), ("run1", 'two\nlines, "quoted"')] and {r.topic for r in got} == {"climate"}


def test_posts_and_texts(spark, tmp_path):
    import bz2

    (tmp_path / "p.jsonl.bz2").write_bytes(bz2.compress(b'{"id": "1", "title": "t"}\nnot json\n{"id": "2"}\n'))
    assert sorted(r.id for r in readers.read_posts(spark, str(tmp_path / "p.jsonl.bz2")).collect()) == ["1", "2"]
    (tmp_path / "in" / "ann").mkdir(parents=True)
    (tmp_path / "in" / "ann" / "1.txt").write_bytes("é".encode("latin-1"))
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path / "in")).collect()] == [("ann", "1.txt", "é")]
    assert readers.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "in")]) == str(tmp_path / "in")


def test_streamed_counts_equal_batch(spark, tmp_path):
    for k in range(3):
        texts_of(spark, [("m", "t", k, "a b a"), ("n", "t", k, "b")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.stream_texts(spark, str(tmp_path / "in"), texts_of(spark, []).schema)
    run = streaming.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in spark.table("streamed").collect()) == [("m", "a", 6), ("m", "b", 3), ("n", "b", 3)]
