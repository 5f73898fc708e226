"""The training-data operators against brute force, on small fixtures with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import components, decontaminate, html, mixing, neighbours, pii, quality, queries, repeats, simhash, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, key string, spans string, `text hash` int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 5 == 0 else "en", f"s{k % 3}" if k % 7 else None, None, "x", "y", "z", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma", "délta", "x1", "It's", "omega,"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 40, 60, 80, 200, 30)]
    near = [base[3].replace("beta", "betb", 1), base[4] + " end", base[2][:200] + " " + base[4][100:500]]
    return [*base, *near, base[1], base[1], "", None, " \n\t ", "Word", "É" * 3, "a" * 900, "ab" * 300 + base[0], sentence(rng, 4000)]


# ---------------------------------------------------------------- 1


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_contamination(text, items, window=13):
    w, hit, found = _words(text), set(), set()
    for item, t in items:
        v = _words(t)
        n = min(len(v), window)
        for a in range(len(v) - n + 1) if v else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark, texts):
    passage = " ".join(texts[4].split()[20:60])
    texts = [*texts, f"{passage} and then {passage}", f"intro {passage[:150]}", "one short", "nothing one SHORT, here"]
    items = [(1, passage), (10, passage), (2, "One short"), (3, None), (4, ""), (None, "Word"), (5, "q q q q q q q q q q q q q q")]
    ids = [*range(len(texts) - 2), None, None]
    bench = spark.createDataFrame([(i, t, "k", 1) for i, t in items], "item_id long, text string, key string, win int")
    got = decontaminate.decontaminate(docs_of(spark, texts, ids), bench).collect()
    want = sorted((*_brute_contamination(t, items),) for t in texts)
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    assert any(r["n_hit"] for r in got)
    # A small block size only changes how the windows are broadcast.
    keep, decontaminate.BROADCAST_BYTES = decontaminate.BROADCAST_BYTES, 2000
    try:
        again = decontaminate.decontaminate(docs_of(spark, texts, ids), bench).collect()
    finally:
        decontaminate.BROADCAST_BYTES = keep
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_decontaminate_empty(spark, texts):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs_of(spark, texts), bench)
    assert got.count() == len(texts) and got.where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs_of(spark, []), bench).count() == 0


# ---------------------------------------------------------------- 2


def test_neighbours_exact_on_small(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 8)).astype(np.float32)
    x[40:60] = x[0]  # one vector of many rows, one of them a query
    rows = [(k, [float(v) for v in a], 1, "c") for k, a in enumerate(x)]
    rows += [(1000, None, 1, "c"), (1050, [0.0] * 8, 1, "c"), (1100, [float("nan")] * 8, 1, "c"), (1150, [None] * 8, 1, "c"), (1200, [float("inf")] + [0.0] * 7, 1, "c"), (1250, [1.0], 1, "c"), rows[5], rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    y = x.astype(float)
    n = np.sqrt((y**2).sum(1))
    for q in range(0, 260, 50):
        s = (y * y[q]).sum(1) / (n * n[q])
        best = [k for k in np.lexsort((np.arange(260), -s)) if k != q][:5]
        mine = [r for r in got if r.query_id == q]
        assert [r.vec_id for r in mine] == best and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == [s[k] for k in best]
    assert {r.query_id for r in got} == set(range(0, 260, 50))


def test_neighbours_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], schema)
    assert [(r.vec_id, r["rank"]) for r in neighbours.nearest(three, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    table = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0, least=1500).toPandas()
    y = x.astype(np.float32).astype(float)
    y /= np.sqrt((y**2).sum(1, keepdims=True))
    hits = 0
    for q, found in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(found.vec_id))
    assert hits / (5 * 120) >= 0.9


# ---------------------------------------------------------------- 3


def test_quality_learns_and_covers_all_rows(spark):
    rng = random.Random(1)
    good = [" ".join(sentence(rng, 1).lower() for _ in range(rng.randint(20, 60))) + "." for _ in range(150)]
    bad = [" | ".join(sentence(rng, 1).upper() + "!!" for _ in range(rng.randint(20, 60))) for _ in range(150)]
    docs = docs_of(spark, [*good, *bad, "", None], [*range(300), 300, None])
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id < 150) for r in held) / len(held) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 140 <= kept.count() <= 160


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs_of(spark, ["a b", None]), none).collect()} == {0.5}
    assert quality.classify(docs_of(spark, []), none).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]


# ---------------------------------------------------------------- 4


def _brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [2 << 20, 500])
def test_repeats(spark, texts, shard):
    # Small shards make one anchor fill several, which are then merged by binary search. The nested function that uses the
    # constant is sent to workers with its value.
    common = texts[18][:700]
    texts = [*texts, *(f"{k} start {common} tail {k * 7919} and so on until {k * 104729} the end of it all, number {k}" for k in range(12)), None, None]
    ids = [*range(len(texts) - 2), None, 3]
    before, repeats.SHARD_BYTES = repeats.SHARD_BYTES, shard
    try:
        got = repeats.remove_repeats(docs_of(spark, texts, ids)).collect()
    finally:
        repeats.SHARD_BYTES = before
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == sorted(_brute_repeats(texts, 200))


def test_shards_merge():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(30)]
    parts = [[(words[rng.randrange(30)] + words[rng.randrange(30)]).encode() for _ in range(25)] for _ in range(3)]
    parts = [list(dict.fromkeys(p)) for p in parts]
    shards = [repeats.Shard(p, [len(c) - 31 for c in p], [1] * len(p), 32) for p in parts]
    for i, s in enumerate(shards):
        for other in shards[:i]:
            s.merge(other)
    count = {}
    for p in parts:
        for c in p:
            for k in range(len(c) - 31):
                count[c[k : k + 32]] = count.get(c[k : k + 32], 0) + 1
    for s, p in zip(shards, parts, strict=True):
        for k, c in enumerate(p):
            flags = [count[c[a : a + 32]] > 1 for a in range(len(c) - 31)]
            assert s.repeated[s.base[k] : s.base[k] + len(flags)].tolist() == flags


@pytest.mark.parametrize("depth", [16, 50, 200])
def test_suffix_array_and_prefixes(depth):
    rng = np.random.default_rng(depth)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    text[2000:2300] = 97
    raw = text.tobytes()
    sa, rank = repeats.suffix_array(text, depth)
    keys = [raw[k : k + depth] for k in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(3000))
    lcp = repeats.common_prefixes(text, sa, rank, depth)
    for k in range(1, 3000):
        a, b = keys[k - 1], keys[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


# ---------------------------------------------------------------- 5


def test_mix_budgets(spark):
    texts = ["w " * n for n in (10, 20, 30, 40, 50, 60, 70, 80, 5, 0)] + [None, "w " * 10]
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "de", f"s{k % 4}", "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, part string, h int")
    got = mixing.mix(docs, {"source": {"s0": 3.0}}, domain=F.lit("all")).collect()
    total = sum(len((t or "").split()) for t in texts)
    used = sum(r.copies * r.n_tokens for r in got)
    assert total - 4 * 80 < used <= total and all(1 <= r.copies <= 4 for r in got)
    # More than everything four times over cannot be had: all rows, four times.
    full = mixing.mix(docs, {}, budget=1e9).collect()
    assert {r.copies for r in full if r.n_tokens} == {4} and len([r for r in full if r.n_tokens]) == 10


def test_mix_water_fill(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 10), ("d", "en", "b", 100), ("d", "de", "c", 100), ("e", "en", "d", 5)], "domain string, lang string, source string, tokens long")
    got = {r.source: round(r.given, 6) for r in mixing.budgets(leaves, 100.0, 1, {}).collect()}
    # e can take 5 of its 50, so d gets 95; en and de 47.5 each; a can take 10 of its 23.75, so its sibling gets the rest.
    assert got == {"a": 10.0, "b": 37.5, "c": 47.5, "d": 5.0}


def test_mix_empty(spark):
    assert mixing.mix(docs_of(spark, []), {}).count() == 0


def test_mix_prefix_is_stable(spark):
    docs = docs_of(spark, ["a b c d e"] * 200)
    one = {r.doc_id: r.copies for r in mixing.mix(docs, {}, budget=300.0).collect()}
    two = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7), {}, budget=600.0).collect()}
    assert set(one) <= set(two) and all(two[k] >= v for k, v in one.items())


# ---------------------------------------------------------------- 6


def _brute_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark, texts):
    ids = [*range(len(texts) - 2), None, 3]
    got = simhash.simhash_dedup(docs_of(spark, texts, ids)).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{_brute_simhash(t):016x}" for t in texts)
    empty = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert empty == {min(i for i, t in zip(ids, texts, strict=True) if i is not None and not (t or "").split())}
    assert simhash.simhash_dedup(docs_of(spark, [])).count() == 0


def test_simhash_classes_of_every_distance(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.append(f)
        for d in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.append(g)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in [rng.sample(range(64), 3) for _ in range(60)]]  # dense, hub itself absent
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.fp: r.root_fp for r in simhash.near_duplicate_classes(table).collect()}
    low = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in low:
            for b in low:
                if low[b] < low[a] and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                    low[a], changed = low[b], True
    assert got == low


def test_components(spark):
    edges = [(a, a + 1) for a in range(50)] + [(100, 200), (200, 300), (400, 400), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 7


def test_token_trees_follow_edits(monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", 4)
    counter = tokens.counter(queries.VOCABULARY)
    rng = random.Random(1)
    letters = "ab c  \n\n'sre1 2é.!?世界ll've  \t"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(300):
        text = some(rng.randint(0, 120))
        tree = tokens.Tree(counter.pieces(text))
        for _ in range(5):
            text, _ = tree.edit(counter, text, rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 30]), some(rng.choice([0, 1, 2, 40])))
            assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_count_tokens(spark, texts):
    docs = docs_of(spark, texts)
    edits = spark.createDataFrame([(1, 0, 5, 10, "new words"), (1, 1, 0, 3, None), (4, 0, -5, 2, "é"), (16, 0, 10**6, 5, "tail"), (12, 0, 0, 0, "was null")], "doc_id long, seq int, start long, length long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(tokens.attach_edits(docs, edits), queries.VOCABULARY, F.col("edits")).collect()}
    counter = tokens.counter(queries.VOCABULARY)
    for k, text in enumerate(texts):
        now = text or ""
        before = len(counter.encoding.encode_ordinary(now))
        for _, _, start, length, put in (e for e in [(1, 0, 5, 10, "new words"), (1, 1, 0, 3, None), (4, 0, -5, 2, "é"), (16, 0, 10**6, 5, "tail"), (12, 0, 0, 0, "was null")] if e[0] == k):
            start = max(start, 0)
            now = now[:start] + (put or "") + now[start + length :]
        assert (got[k].n_tokens, got[k].n_tokens_edited, got[k].n_chars_edited) == (before, len(counter.encoding.encode_ordinary(now)), len(now))
    assert got[1].n_edits == 2 and 0 < got[4].n_chars_encoded < 60
    assert tokens.count_tokens(docs_of(spark, []), queries.VOCABULARY, queries.example_edits()).count() == 0


# ---------------------------------------------------------------- 8


def test_pii_base_and_redaction(spark):
    texts = ["mail a.b+c@ex-1.example.org, c@d @e a@b.c.d", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 not 4111 1111 1111 1112", "call +1 (212) 555-0100 or +12", "", None, "nothing here", "x" * 5000 + "@a.b"]
    docs = docs_of(spark, texts, [0, 1, 2, 3, 4, None, 6, 6])
    got = [[(s["kind"], s["start"], s["end"]) for s in r.spans] for r in pii.find_pii(docs).collect()]
    patterns = {k: re.compile(p) for k, p in zip(pii.PATTERNS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True)}
    want = [[(k, m.start(), m.end()) for k, p in patterns.items() for m in p.finditer(t or "") if pii._valid(k, m[0])] for t in texts]
    assert sorted(got) == sorted(want) and [("card", 5, 24)] in got and sum(map(len, got)) == 7
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    out = {r.text for r in clean.collect()}
    assert "mail [EMAIL], c@d @e [EMAIL]" in out and "nothing here" in out and None in out and "" in out
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def test_pii_disclosing_terms(spark):
    rng = random.Random(3)
    other = [sentence(rng, 30) for _ in range(60)]
    told = [f"{sentence(rng, 3)} we asked Zorblatt near boss@corp.example and {sentence(rng, 2)} that was {k}" for k in range(6)]
    got = pii.find_pii(docs_of(spark, [*other, *told])).collect()
    marked = {(r.doc_id, t) for r in got for s in r.spans if s["kind"] == "term" for t in [([*other, *told])[r.doc_id][s["start"] : s["end"]]]}
    assert {(60 + k, "Zorblatt") for k in range(6)} <= marked and not any(d < 60 for d, _ in marked)
    # Copies of one text prove nothing.
    copies = pii.find_pii(docs_of(spark, [*other, *[told[0]] * 6])).collect()
    assert not any(s["kind"] == "term" for r in copies for s in r.spans)


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    import base64

    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    pages = [(1, "u1", "same"), (2, "u2", "same"), (12, None, "same"), (3, "u3", tricky), (4, "u4", tricky), (5, "u5", None), (6, "u6", ""), (7, "u\r\n7", "ü" * 30), (7, "u\r\n7", "ü" * 30), (None, "n", "nobody's"), (8, "e", "ends\r\n"), (9, "e", "ends\r")]
    table = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, n_bytes int")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(table, least=least).collect())
    want, seen = [], {}
    for p, _, h in sorted(pages, key=lambda x: -(x[0] or 0)):
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = seen.get(raw) if len(raw) >= least else None
        want.append((p or 0, len(raw), digest, "revisit" if first else "response", first))
        seen.setdefault(raw, p)
    key = lambda r: (r[0], r[1], r[3], r[4] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, lots of them, really.</div>
<form action=s><input><p>Search the site for something useful, now.</p></form><div id=wrap><article><h1>The   title &amp; more</h1><p>First paragraph, with a comma, and
 <b>bold<br>text</b>&nbsp;here that is long enough to count.<p>Second one &lt;kept&gt;, also long enough to be counted as prose.</p><div class="ad">Buy, buy, buy this thing today, dear reader.</div>
<ul><li>An item</li><li>Another</li></ul><section class="comments"><article class="comment"><p>Nice post, I really, really liked it, thanks a lot.</p></article></section></article>
<aside><p>Related things, many, many of them, over here.</p></aside></div><footer>&copy; Nobody, nowhere, never.</footer>"""


def test_html():
    assert html.extract(PAGE).split("\n\n") == ["The title & more", "First paragraph, with a comma, and bold text here that is long enough to count.", "Second one <kept>, also long enough to be counted as prose.", "An item", "Another"]
    assert html.extract(None) == html.extract("") == html.extract("<script>x</script>") == ""
    assert html.extract("plain words only") == "plain words only"
    plain = "<body><div class=menu><a href=a>one</a></div><div class=post><p>Some prose that is, after all, long enough.</p><p>And more of it, to be sure, as said.</p></div><div class=footer>bye</div>"
    assert html.extract(plain) == "Some prose that is, after all, long enough.\n\nAnd more of it, to be sure, as said."
    assert html.extract("<div>" * 5000 + "deep text, rather deep, indeed" + "</div>" * 5000) == "deep text, rather deep, indeed"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got) == sorted([len(html.extract(PAGE))] * 2 + [0]) and len(got) == 3
    assert html.extract_pages(spark.createDataFrame([], pages.schema)).count() == 0


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got = queries.QUERIES[name](spark, data)
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, got.select(*columns).toPandas().astype(object).where(lambda d: d.notna(), None).to_numpy().tolist())) == sorted(repr(list(r)) for r in cursor.fetchall())


def test_pii_terms_inside_spans_are_left_out():
    """The bisection over merged spans against all spans one by one; overlapping spans of several kinds."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "betagamma", "delta@mail.example.org", "10.0.0.1", "+49 30 1234 5678", "4111 1111 1111 1111", "+4111111111111111"]) for _ in range(400))
    spans = pii.base_spans(text)
    for context in pii._contexts(text, spans, 10):
        assert not any(s < t["end"] and t["start"] < e for t in context["terms"] for _, s, e in spans)
    assert any(c["terms"] for c in pii._contexts(text, spans, 10))


def test_pii_addresses_like_the_plain_pattern():
    rng, plain = random.Random(4), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice("0129..a ") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in pii.PATTERNS["ip"].finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_contaminated_at_exactly_the_share(spark):
    """7 words of 140 are a twentieth, though 0.05 * 140 is more than 7 in binary fractions."""
    docs = spark.createDataFrame([(1, " ".join([*"abcdefg", *(f"w{k}" for k in range(133))])), (2, " ".join([*"abcdefg", *(f"w{k}" for k in range(134))]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()} == {1: (7, True), 2: (7, False)}


def test_pii_copies_do_not_hide_a_disclosing_term(spark):
    """Five texts have the term by the address; one of them is there 1,000 times."""
    rng = random.Random(3)
    other = [sentence(rng, 30) for _ in range(300)]
    told = [f"{sentence(rng, 3)} we asked Zorblatt near boss@corp.example and {sentence(rng, 2)} that was {k}" for k in range(5)]
    rows = [*other, *told, *[told[0]] * 999]
    for r in pii.find_pii(docs_of(spark, rows)).collect():
        terms = {rows[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "term"}
        assert ("Zorblatt" in terms) == (r.doc_id >= 300)


def test_pii_terms_anywhere_and_of_rarer_entities(spark):
    """An address in two texts; its owner's name far above it, and again below."""
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100))
    other = [filler() for _ in range(400)]
    told = [f"Zorblatt {filler()} boss@corp.example {filler()} zorblatt." for _ in range(2)]
    once = [f"Quuxley {filler()} else@corp.example"]
    rows = [*other, *told, *once]
    for r in pii.find_pii(docs_of(spark, rows)).collect():
        terms = [rows[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "term"]
        assert ("Zorblatt" in terms and "zorblatt" in terms) if 400 <= r.doc_id < 402 else not terms
    # The nearest terms are those by count, however far.
    text = "alpha " + "1 " * 300 + "a@b.c" + " 2" * 300 + " omega"
    assert pii._contexts(text, pii.base_spans(text), 1)[0]["context"] == "alpha omega"


def test_pii_terms_are_cut_alike_by_engine_and_python(spark):
    texts = ["Straße ÉCOLE x²yzabc abcd²efgh \u0130stanbul na\u0308ive ΣΟΦΟΣ under_score ab12cdef 中文字词语 abc", "", None]
    got = {r.text: set(r.t) for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii._term_list(F.col("text")).alias("t")).collect()}
    assert got == {t: {r[0] for r in pii._runs(t or "")} for t in texts}
