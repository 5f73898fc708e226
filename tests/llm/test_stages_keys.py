"""The pipeline's stages on null and repeated keys, clashing columns, nulls, empty texts and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import common, pii, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, row string, `again` int, k int, h int, spans string, id string, value string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "x", "y", "z", 1, 2, 3, "s", "i", "v") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    rng = random.Random(21)
    passage = prose(rng, 30)
    path = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(1, passage), (2, "tiny item")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), passage


@pytest.mark.parametrize("bytes_", [48 << 20, 0])
def test_one_passage_in_a_long_document_is_found_and_other_texts_stay(spark, bench, bytes_, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes_)  # nothing fits: joined by a shuffle
    path, passage = bench
    rng = random.Random(22)
    window = " ".join(passage.split()[7:20])
    texts = [(1, f"{prose(rng, 3000)} {window} {prose(rng, 3000)}"), (1, "another text under the same id"), (None, f"{window} and more"), (None, "no id, no passage"),
             (2, f"{prose(rng, 100)} tiny item {prose(rng, 100)}"), (3, "a tiny item"), (4, None), (5, ""), (6, " ".join(window.split()[:12])), (7, "twice"), (7, "twice")]
    docs = rows_of(spark, texts)
    got = stages.decontaminated(spark, docs, path)
    assert got.columns == docs.columns
    want = [t for k, t in enumerate(texts) if k not in (0, 2, 5)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("bytes_", [48 << 20, 0])
def test_one_of_each_class_whatever_the_keys(spark, bytes_, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes_)
    rng = random.Random(23)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    docs = rows_of(spark, [(None, a), (None, b), (1, c), (1, d), (1, d), (9, e), (8, e), (7, None), (6, ""), (6, ""), (6, "")])
    got = stages.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(None, a), (None, b), (1, c), (1, d), (8, e), (6, "")]))


def test_sanitised_rows_keep_their_other_columns(spark):
    rows = [(1, "mail a@b.example now"), (1, "none here"), (None, "mail a@b.example now"), (None, None), (2, ""), (3, "at 10.0.0.1"), (3, "at 10.0.0.1")]
    docs = rows_of(spark, rows)
    got = stages.sanitised(spark, docs, "")
    assert got.columns == docs.columns
    want = [(i, t if t is None else t.replace("a@b.example", "[EMAIL]").replace("10.0.0.1", "[IP]")) for i, t in rows]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in rows_of(spark, want).collect())


def test_empty_tables_and_no_labels(spark, bench):
    path, _ = bench
    docs = rows_of(spark, [(1, "a b"), (None, None)])
    assert stages.without_poor(spark, docs, path).count() == 2
    for stage in (stages.without_poor, stages.one_of_each, stages.decontaminated, stages.sanitised, stages.mixed):
        assert stage(spark, docs.where("false"), path).count() == 0
    assert pii.sanitise(docs.where(F.lit(False))).columns == docs.columns
