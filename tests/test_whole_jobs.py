"""Queries that once did less than their whole job, on small tables of their own."""

import random

import pytest

from corpuscle.plans import catalogue


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two sources, alike in text lengths, not in sentence lengths; two languages, and a text without."""
    rng = random.Random(8)

    def text(size):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(60)]
        return " ".join(w.capitalize() if k % size == 0 else w + "." if k % size == size - 1 else w for k, w in enumerate(words))

    rows = [(10 * k + m, text(3 if m else 20), ("de", "en")[k % 2] if k else None, f"src{m}") for k in range(13) for m in range(2)]
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_verdict_has_all_six_conditions(spark, small):
    row = catalogue.QUERIES["pair_fingerprint_verdict"](spark, small).first()
    assert row.ks_p > 0.05 > row.sentence_ks_p
    assert "sentence_lengths" in row.warnings.split(",") and "text_lengths" not in row.warnings.split(",")
    assert ("delta" in row.warnings.split(",")) == (row.burrows_chunked > 1)


def test_distances_of_every_scope(spark, small):
    got = catalogue.QUERIES["distance_long"](spark, small).collect()
    assert sorted({r.scope for r in got}) == ["de", "en", "pooled"]
    assert all(len({r.metric for r in got if r.scope == s}) == 12 for s in ("de", "en", "pooled"))


def test_resampling_with_all_repetitions(spark, small):
    assert {r.n for r in catalogue.QUERIES["bootstrap_ttr_ci"](spark, small).collect()} == {1000}
    assert {r.n for r in catalogue.QUERIES["within_corpus_split_half"](spark, small).where("kind = 'within_split'").collect()} == {100}


def test_consensus_of_fifty_half_samples(spark, tmp_path):
    rng = random.Random(9)
    own = lambda m: ["only" + "xy"[m]] * 4 + ["rare" + "xy"[m]] if rng.random() < 0.8 else []
    rows = [(10 * k + m, " ".join([*own(m), *["same", "words"] * 10]), "de", f"src{m}") for k in range(16) for m in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.token: r.selection_rate for r in catalogue.QUERIES["keyness_consensus"](spark, str(tmp_path)).collect()}
    assert {"onlyx", "onlyy"} <= set(got) and not {"rarex", "rarey"} & set(got)  # at most 16 times: under 20
    assert all(round(50 * rate, 6) == int(round(50 * rate)) for rate in got.values())


def test_distances_leave_no_table_of_words(spark, small, tmp_path, monkeypatch):
    from corpuscle.sources import readers

    monkeypatch.setattr(readers, "LOCAL_DEFAULT", str(tmp_path))
    catalogue.QUERIES["distance_long"](spark, small)
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "corpuscle").iterdir()}
    assert "distances" in left and not {"words", "words-by-topic", "bounds"} & left
