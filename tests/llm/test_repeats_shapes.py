"""Repeats in texts of hostile shape, against brute force: periods, rulers, long texts in chunks, one anchor in many surroundings."""

import random

import numpy as np
import pytest
from test_training_data import _brute_repeats, docs_of

from corpuscle.llm import repeats


def test_periods_are_one_run_each():
    for text in (b"x" * 20_000, b"=-" * 10_000, bytes(range(100)) * 300):
        first, count, _, places = repeats.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]), 200)
        assert len(first) <= 3 and count.sum() == len(text) - 199 and places.sum() >= len(text) // 110
        assert sorted(w for a, n in zip(first, count, strict=True) for w in range(a, a + n)) == list(range(len(text) - 199))


@pytest.mark.parametrize(("chunk", "run", "shard"), [(64 << 20, 1 << 16, 2 << 20), (1000, 100, 3000)])
def test_shapes(spark, monkeypatch, chunk, run, shard):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "RUN_WINDOWS", run)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = noise(230)
    texts = ["-" * 900, noise(400) + "-" * 350 + noise(300), "ab" * 450, noise(50) + "ab" * 120, noise(3000), None, "", "-" * 199, "-" * 200]
    texts += [noise(rng.randint(150, 250)) + line + noise(200) for _ in range(40)] + [noise(2500) + line[:201] + noise(10) + line[5:210]]
    got = repeats.remove_repeats(docs_of(spark, texts)).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == sorted(_brute_repeats(texts, 200))
