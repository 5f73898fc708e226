import random

from pyspark.sql import functions as F

from corpuscle.llm import queries, tokens


def test_trees_outlive_batches_of_edits(spark, tmp_path):
    """Trees written as tables follow three batches of edits, a long text, a null and a repeated key among them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé1'. \n") for _ in range(rng.randint(1, 9)))
    texts = {0: None, 1: "", 2: "one two three", 3: " ".join(word() for _ in range(60_000)), **{k: " ".join(word() for _ in range(200)) for k in range(4, 12)}}
    docs = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string")
    counter = tokens.counter(queries.VOCABULARY)
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    tokens.plant_trees(docs, queries.VOCABULARY).write.parquet(f"{tmp_path}/0")
    now = {k: t or "" for k, t in texts.items()}
    planted = spark.read.parquet(f"{tmp_path}/0")
    assert sorted((r.doc_id, r.n_tokens) for r in planted.collect()) == sorted([*((k, whole(t)) for k, t in now.items()), (2, whole(now[2]))])
    for turn in range(3):
        rows = [(k, s, rng.randint(0, len(now[k]) + 3), rng.choice([0, 1, 40]), word()) for k in now if k != 11 for s in range(3)]
        edits = spark.createDataFrame(rows, "doc_id long, seq int, start long, length long, text string")
        held = spark.read.parquet(f"{tmp_path}/{turn}")
        changed = tokens.edit_trees(tokens.attach_edits(held, edits), queries.VOCABULARY, F.col("edits"))
        changed.write.parquet(f"{tmp_path}/{turn + 1}")
        before = dict(now)
        for k, _, start, length, put in rows:
            at = min(start, len(now[k]))
            now[k] = now[k][:at] + put + now[k][at + length :]
        for r in spark.read.parquet(f"{tmp_path}/{turn + 1}").collect():
            assert r.text == now[r.doc_id] and r.n_tokens == whole(r.text) and r.n_tokens_before == whole(before[r.doc_id])
            assert (sum(r.leaf_sizes), sum(r.piece_chars), sum(r.piece_tokens)) == (len(r.piece_chars), len(r.text), r.n_tokens)
            assert r.n_edits == (0 if r.doc_id == 11 else 3) and (r.doc_id != 3 or r.n_chars_encoded < 2_000)
    assert tokens.edit_trees(spark.read.parquet(f"{tmp_path}/3").limit(0), queries.VOCABULARY, F.array()).count() == 0
