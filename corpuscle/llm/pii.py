"""PII: personal data by pattern, and terms that give it away by information-theoretic disclosure."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, in_one_column, small, written

#: The base patterns, in the order in which spans are listed.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # Not from inside a run of digits, nor giving digits back: the matches are the same, found in linear time.
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*PATTERNS, "term")
_RUN = re.compile(r"[^\W\d_]+")
#: A term is a run of at least so many letters.
TERM_LETTERS = 4
_AT_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
CONTEXT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("context", T.StringType())])
#: A term of a text and where it stands outside base spans; nowhere, if only inside them.
TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("at", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.split("."))
    digits = _NOT_DIGIT.sub("", match)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail matches, found from each @: linear, however long a run without one is."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and (text[first - 1] in "._%+-" or (text[first - 1].isascii() and text[first - 1].isalnum())):
            first -= 1
        domain = _DOMAIN.match(text, at) if first < at else None
        if domain:
            done = domain.end()
            yield first, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text by pattern: code points, end exclusive, by kind as listed, then start."""
    if not text:
        return []
    found = [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            if kind == "phone" and "+" not in text:
                continue
            found += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return found


def _runs(text: str) -> list[tuple[str, int, int]]:
    """The terms of a text, lower-cased, with start and end: runs of the characters that \\p{L} matches, as in `_term_list`."""
    out = []
    for m in _RUN.finditer(text):
        if m.end() - m.start() < TERM_LETTERS:
            continue
        if m[0].isalpha():
            out.append((m[0].lower(), m.start(), m.end()))
            continue
        start = m.start()
        for at in range(m.start(), m.end() + 1):  # numerals such as a superscript two end a run
            if at == m.end() or not text[at].isalpha():
                if at - start >= TERM_LETTERS:
                    out.append((text[start:at].lower(), start, at))
                start = at + 1
    return out


def _term_list(text: Column) -> Column:
    """The different terms of a text."""
    runs = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}]+")
    return F.array_distinct(F.transform(F.filter(runs, lambda r: F.char_length(r) >= TERM_LETTERS), F.lower))


def _outside(runs: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[bool]:
    """For each run whether it lies outside all spans."""
    # Overlapping spans are merged, so that a bisection finds the last one that begins before a term ends.
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if not ends or start >= ends[-1]:
            starts.append(start)
            ends.append(end)
        else:
            ends[-1] = max(ends[-1], end)
    out = []
    for _, start, end in runs:
        at = bisect_left(starts, end) - 1
        out.append(at < 0 or ends[at] <= start)
    return out


def _contexts(text: str, spans: list[tuple[str, int, int]], words: int, runs: list[tuple[str, int, int]] | None = None) -> list[dict]:
    """For each base span its entity and the `words` nearest terms on either side: all as `context`, those outside spans as `terms`."""
    runs = _runs(text) if runs is None else runs
    outside = _outside(runs, spans)
    first, last = [r[1] for r in runs], [r[2] for r in runs]
    out = []
    for kind, start, end in spans:
        lo, hi = bisect_right(last, start), bisect_left(first, end)
        near = [*range(max(0, lo - words), lo), *range(hi, min(len(runs), hi + words))]
        value = text[start:end].lower() if kind == "email" else _NOT_DIGIT.sub("." if kind == "ip" else "", text[start:end])
        terms = [dict(zip(("term", "start", "end"), runs[k], strict=True)) for k in near if outside[k]]
        out.append({"entity": f"{kind}:{value}", "context": " ".join(runs[k][0] for k in near), "terms": terms})
    return out


def _terms(runs: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[dict]:
    found: dict[str, list[dict]] = {}
    for (term, start, end), free in zip(runs, _outside(runs, spans), strict=True):
        at = found.setdefault(term, [])
        if free:
            at.append({"start": start, "end": end})
    return [{"term": t, "at": at} for t, at in found.items()]


def find_base(docs: DataFrame, text: str, keep: tuple[str, ...], words: int) -> DataFrame:
    """The columns `keep`, `spans`, `contexts` and, where there are spans, `terms` of every row. No shuffle."""
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    more = [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("contexts", T.ArrayType(CONTEXT)), T.StructField("terms", T.ArrayType(TERM))]
    schema = T.StructType([*source.schema.fields[:-1], *more])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType, prefers_large_types=False) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, contexts, terms = [], [], []
            for value in batch.column(len(keep)):
                value = value.as_py()
                found = base_spans(value)
                runs = _runs(value) if found else []
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                contexts.append([{"entity": c["entity"], "context": c["context"]} for c in _contexts(value, found, words, runs)] if found else [])
                terms.append(_terms(runs, found))
            columns = [pa.array(v, t) for v, t in zip((spans, contexts, terms), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _by_copies(docs: DataFrame, copies: DataFrame, n_copied: int) -> DataFrame:
    """`docs` (with `__hash`) with `weight`, 1 over the number of rows with the same text: a text's rows add up to 1.

    copies: `__hash`, `m` of the texts with more than one row, broadcast in blocks of checked size.
    """
    blocks = max(1, -(-n_copied * 48 // BROADCAST_BYTES))
    for k in range(blocks):
        block = copies.where(F.pmod("__hash", F.lit(blocks)) == k).select(F.col("__hash").alias(f"__h{k}"), F.col("m").alias(f"__m{k}"))
        docs = docs.join(F.broadcast(block), F.col("__hash") == F.col(f"__h{k}"), "left")
    return docs.withColumn("weight", F.lit(1.0) / F.coalesce(*(f"__m{k}" for k in range(blocks)), F.lit(1)))


def disclosing_terms(docs: DataFrame, text: str, held: DataFrame, terms_of: DataFrame, threshold: float, remove: float) -> DataFrame:
    """Which terms reveal which entities: `entity`, `term`, `disclosure`, `action`.

    docs: `__hash` and the text. held: `__hash` (of the text), `entity`, `context`, one row per entity of a text. terms_of:
    `__hash`, `terms` of each text that holds entities. All counts are of different texts, so copies of a text neither
    prove nor hide anything. With N texts, a term in n_t of them, an entity in n_e and both in n_te, the pointwise mutual
    information log(N n_te / (n_t n_e)) over the entity's information log(N / n_e) is the share of the entity that the
    term discloses. n_te is smoothed by leaving one observation out: of the k different contexts that the entity has in
    those n_te texts, k - 1 count, that is n_te (k - 1) / k. So texts that read alike around the entity count as one
    observation, and one observation proves nothing: it makes every rare word of its text look exclusive. Terms
    from `remove` on are removed, others from `threshold` on are generalised.
    """
    by_text = written(docs.groupBy("__hash").agg(F.count(F.lit(1)).alias("m")), "texts")
    copies = by_text.where("m > 1")
    n_copied, total = copies.count(), by_text.count()
    # An entity with one context has no term with two; most entities go here, before their texts' terms are looked at.
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("context").alias("k")).where((F.col("k") > 1) & (F.col("n_e") < total))
    held = written(held.join(entities.select("entity", "n_e"), "entity"), "held")
    terms_of = written(terms_of.join(held.select("__hash").distinct(), "__hash", "left_semi").select("__hash", F.explode("terms").alias("term")), "terms-held")
    seen = held.join(terms_of, "__hash").groupBy("entity", "n_e", "term", "context").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = seen.groupBy("entity", "n_e", "term").agg(F.sum("n_te").alias("n_te"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = pairs.select("entity", "n_e", "term", (F.col("n_te") * (F.col("k") - 1) / F.col("k")).alias("n_te"))
    # A term is in at least the texts that hold it and such an entity. Where these are too many already, the
    # threshold is out of reach, and the term need not be counted in all texts.
    around = terms_of.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    reach = F.col("n_te") * F.pow(F.lit(float(max(total, 2))) / F.col("n_e"), F.lit(1 - threshold)) * (1 + 1e-9)
    pairs = written(pairs.join(around, "term").where(F.col("n_near") <= reach), "pairs")
    terms = written(pairs.select("term").distinct(), "terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-size // BROADCAST_BYTES))
    weighed = _by_copies(docs, copies, n_copied)
    words = weighed.select("weight", F.explode(_term_list(F.col(text))).alias("term"))
    counted = [words.join(F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)), "term").groupBy("term").agg(F.round(F.sum("weight")).alias("n_t")) for k in range(blocks if size else 0)]
    if not counted:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    scored = pairs.join(reduce(DataFrame.unionByName, counted), "term", "left")
    n_t = F.greatest(F.coalesce("n_t", F.lit(0.0)), F.col("n_near"))
    information = F.log(F.lit(float(max(total, 2))) / F.col("n_e"))
    mutual = F.log(F.lit(float(max(total, 2))) * F.col("n_te") / (n_t * F.col("n_e")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return (
        scored.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold)
        .withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))
    )


def find_pii(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 10,
    threshold: float = 0.8,
    remove: float = 0.95,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The personal data of every row: `key`, `carry` columns, `spans` (kind, start, end; code points, end exclusive,
    by kind and start; a term's kind is "term") and `removed` (starts of the terms to remove, not to generalise).

    Base spans (e-mail, IP address, payment card, phone) come from the row alone. Terms come from the corpus: see
    `disclosing_terms`; a term is a run of 4 or more letters, and is marked wherever it stands outside base spans in a text
    that holds the entity. An entity's context is its `words` nearest terms on either side, however far. Counts cover all documents; candidate terms are broadcast in blocks of checked size.

    A null or empty text has no spans. Repeated rows each come back with the same spans; rows with one key and
    different texts are kept apart by their text's hash. A null key is a key like any other. An empty table gives no rows.
    """
    named = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), *(F.col(c).alias(f"__c_{c}") for c in carry), F.col(text).alias("__text"))
    keep = ("__key", "__hash", *(f"__c_{c}" for c in carry))
    found = written(find_base(named, "__text", keep, words), "base-spans")
    # A text has one context of an entity, so that one text is one observation.
    full = found.where(F.size("contexts") > 0)
    held = written(full.select("__hash", F.explode("contexts").alias("c")).groupBy("__hash", "c.entity").agg(F.min("c.context").alias("context")), "entities")
    terms_of = full.select("__hash", F.transform("terms", lambda t: t["term"]).alias("terms")).dropDuplicates(["__hash"])
    told = written(disclosing_terms(named, "__text", held, terms_of, threshold, remove), "disclosing")
    by_term = held.join(told, "entity").groupBy("__hash", "term").agg(F.max(F.col("action") == "remove").alias("gone"))
    marked = written(by_term.groupBy("__hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("told")), "marked")
    places = F.flatten(F.transform(F.filter("f.terms", lambda t: F.map_contains_key("m.told", t["term"])), lambda t: F.transform(t["at"], lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), F.element_at("m.told", t["term"]).alias("gone")))))
    both = found.alias("f").join(marked.alias("m"), F.col("f.__hash") == F.col("m.__hash"), "left").withColumn("places", F.when(F.col("m.told").isNotNull(), F.array_sort(places)))
    more = F.transform("places", lambda p: F.struct(F.lit("term").alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    removed = F.transform(F.filter("places", lambda p: p["gone"]), lambda p: p["start"])
    return both.select(
        F.col("f.__key").alias(key), *(F.col(f"f.__c_{c}").alias(c) for c in carry), F.when(F.col("places").isNull(), F.col("f.spans")).otherwise(F.concat("f.spans", more)).alias("spans"),
        F.coalesce(removed, F.array().cast("array<bigint>")).alias("removed"), F.col("f.__hash").alias("text_hash"),
    )


def _shape(term: str) -> str:
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def redact(text: str | None, spans: list, removed: list | None) -> str | None:
    """The text with each span replaced by its kind, generalised terms by their shape, removed ones by nothing."""
    if not text or spans is None or not len(spans):
        return text
    gone, out, at = set(removed if removed is not None else ()), [], 0
    for kind, start, end in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda s: (s[1], -s[2])):
        if start < at:  # overlaps what is replaced already
            at = max(at, end)
            continue
        out.append(text[at:start])
        out.append(("" if start in gone else _shape(text[start:end])) if kind == "term" else f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with personal data and disclosing terms of `text` replaced; all rows and columns stay.

    Only rows that hold spans meet them, on the key and the text's hash, and only they go through Python. Spans of checked
    size are broadcast, so that texts stay where they are. See `find_pii` for nulls, ties and repeated rows; columns of
    any other name come through untouched.
    """
    found = find_pii(docs, key, text, **options).where(F.size("spans") > 0)
    found = written(found.select(F.col(key).alias("k"), F.col("text_hash").alias("h"), "spans", "removed").dropDuplicates(["k", "h"]), "redactions")
    found = small(found, 64 + 32 * F.size("spans") + 8 * F.size("removed"))
    rows = in_one_column(docs, id=F.col(key), value=F.col(text), hash=F.xxhash64(text))
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))

    @F.udf(T.StringType(), useArrow=True)
    def clean(value, spans, removed):
        return redact(value, spans, removed)

    hit = rows.join(found, same).withColumn("clean", clean("value", "spans", "removed"))
    hit = hit.select(*(F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
    return rows.join(found, same, "left_anti").select("row.*").unionByName(hit)
