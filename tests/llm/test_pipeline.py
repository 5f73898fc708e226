"""The pipeline's stages on a planted corpus, against what each should keep."""

import random

import pytest

import corpus_pipeline
from corpuscle.llm import stages

DATA = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontaminate", "pii", "mix"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Good texts, shouted ones, copies, near copies, one with a benchmark passage, one with an address."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.choice([2, 3, 4, 5, 6, 8, 12, 18]))) for _ in range(n)) + "."
    passage = prose(40)
    good = [prose(rng.randint(60, 120)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(80).split()) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate([*good, *bad])]
    rows += [(200, good[0]), (201, good[1] + " end"), (202, prose(30) + " " + passage + " " + prose(30)), (203, prose(60) + " write to a.b@c.example.org now. " + prose(30)), (204, good[2]), (204, good[2])]
    path = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_each_stage_keeps_what_it_should(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    good = stages.without_poor(spark, docs, planted)
    assert good.columns == docs.columns and ids(good) == [*range(60), 200, 201, 202, 203, 204, 204]
    unique = stages.one_of_each(spark, good, planted)
    assert unique.columns == docs.columns and ids(unique) == [*range(60), 202, 203]
    clean = stages.decontaminated(spark, unique, planted)
    assert clean.columns == docs.columns and ids(clean) == [*range(60), 203]
    safe = stages.sanitised(spark, clean, planted)
    text = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns and "[EMAIL]" in text[203].text and "@" not in text[203].text and text[203].n_chars == len(text[203].text)
    assert all(text[k].text == r.text for r in clean.collect() if (k := r.doc_id) != 203)
    used = stages.mixed(spark, safe, planted).collect()
    assert {r.doc_id for r in used} <= set(text) and sum(r.copies * r.n_tokens for r in used) <= sum(len(r.text.split()) for r in text.values())


def test_run_is_the_stages_in_order(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, planted)
    assert sorted(map(repr, corpus_pipeline.run(spark, planted).collect())) == sorted(map(repr, docs.collect()))
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_nothing_left_of_an_empty_corpus(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, planted)
    assert docs.count() == 0


def test_unique_texts_stay_without_ids_and_under_one_id(spark):
    """Texts without an id, twice each; two texts under one id; a copy with an id of a text without."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(80)) for _ in range(12)]
    rows = [*((None, t) for t in texts[:8] for _ in range(2)), (5, texts[8]), (5, texts[9]), (5, texts[9]), (7, texts[0]), (9, texts[10]), (8, texts[10]), (1, texts[11])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in stages.one_of_each(spark, docs, "").collect()))
    assert got == sorted([*((0, t) for t in texts[1:8]), (7, texts[0]), (5, texts[8]), (5, texts[9]), (8, texts[10]), (1, texts[11])])
