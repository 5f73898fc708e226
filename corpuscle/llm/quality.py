"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fits, written

FEATURES = (
    "bytes", "words", "lines", "upper", "lower", "digit", "space", "other_bytes", "comma", "stop", "bang", "bar", "symbol", "dash", "quote",
    "word_size", "word_spread", "types", "repeats", "line_size", "line_repeats", "longest",
)


def statistics(text: bytes | None) -> np.ndarray:
    """The FEATURES of one UTF-8 text; all 0 for a null or empty one."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[:3] = np.log1p([n, len(words), len(lines)])
    groups = (range(65, 91), range(97, 123), range(48, 58), (9, 10, 13, 32), range(128, 256), b",", b".?", b"!", b"|<>[]{}=_", b"%$#&*@^~\\", b"-:;/+", b"\"'()")
    out[3:15] = [hist[list(g)].sum() / n for g in groups]
    if words:
        types = len(set(words))
        out[15:19] = sizes.mean(), sizes.std(), types / len(words), np.log1p(len(words) / types)
        out[21] = np.log1p(sizes.max())
    if lines:
        out[19:21] = np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines)
    return out


def features(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` and `f` (array of FEATURES) of every row. No shuffle."""
    source = docs.select(*keep, F.col(text).cast("string").cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("f", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()).astype(np.float32) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float32()))], [*keep, "f"])

    return source.mapInArrow(run, schema)


@dataclass
class Model:
    """A fitted classifier: a few hundred numbers, carried to executors in closures."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.waves + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing values nearest to y in weighted least squares: neighbours that violate the order are pooled."""
    means, weights, counts = [], [], []
    for value, w in zip(y, weight, strict=True):
        means.append(float(value))
        weights.append(float(w))
        counts.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w2 = weights[-2] + weights[-1]
            means[-2] = (means[-2] * weights[-2] + means[-1] * weights[-1]) / w2
            weights[-2], counts[-2] = w2, counts[-2] + counts[-1]
            del means[-1], weights[-1], counts[-1]
    return np.repeat(means, counts)


#: Width of a calibration bin of raw scores, and how many bins at most reach the driver.
_BIN, _BINS = 1 / 400, 1600


def fit(training: DataFrame, waves: int = 256, bandwidth: float = 1.0, ridge: float = 1.0, seed: int = 7) -> Model:
    """Fit on rows of `f` (statistics) and `y` (label, 0 to 1): all of them.

    Each partition sums its part of the normal equations; parts are added up by row of the matrix, so that the driver
    gets one matrix of fixed size. Calibration pools rows into at most 1601 bins of raw score before it reaches the driver.
    Without any row the model scores 0.5.
    """
    training = written(training.where(F.col("y").isNotNull() & F.col("f").isNotNull()).select("f", F.col("y").cast("double").alias("y")), "training")
    d = len(FEATURES)
    stats = training.agg(*(g(F.col("f")[k].cast("double")).alias(f"{n}{k}") for k in range(d) for n, g in (("m", F.avg), ("s", F.stddev_pop))), F.count(F.lit(1)).alias("n")).first()
    rng = np.random.default_rng(seed)
    mean = np.array([stats[f"m{k}"] or 0.0 for k in range(d)])
    spread = np.array([stats[f"s{k}"] or 0.0 for k in range(d)])
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, bandwidth / np.sqrt(d), (d, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not stats.n:
        return model

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            z = model.lift(np.stack(batch.f.to_numpy()).astype(float))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.y.to_numpy()
        yield pd.DataFrame({"i": np.arange(waves + 1), "v": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [rows.i.iloc[0]], "v": [np.sum(np.stack(rows.v.to_numpy()), axis=0)]})

    sums = training.mapInPandas(partial, "i long, v array<double>").groupBy("i").applyInPandas(added, "i long, v array<double>").collect()
    matrix = np.array([r.v for r in sorted(sums, key=lambda r: r.i)])
    penalty = np.full(waves + 1, ridge)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(matrix[:, :-1] + np.diag(penalty), matrix[:, -1])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = np.clip(np.round(model.raw(np.stack(batch.f.to_numpy()).astype(float)) / _BIN), -_BINS // 4, 3 * _BINS // 4)
            yield pd.DataFrame({"b": bins.astype(int), "y": batch.y.to_numpy()})

    bins = training.mapInPandas(raw, "b int, y double").groupBy("b").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    bins.sort(key=lambda r: r.b)
    n = np.array([r.n for r in bins], float)
    # One pseudo-row at the overall rate in each bin keeps a bin of few rows from being certain.
    rate = sum(r.y for r in bins) / n.sum()
    y = np.array([r.y for r in bins])
    model.knots, model.values = np.array([r.b * _BIN for r in bins]), isotonic((y + 0.2 * rate) / (n + 0.2), n + 0.2)
    return model


def held_out(key: Column) -> Column:
    """Rows that training never sees: crc32 of the key as text, modulo 3, is 1. A null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Statistics of the rows with a label outside the held-out part; a key with several labels has their mean."""
    given = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.avg(label).alias("y"))
    return stats.join(given, F.col("__k") == F.col("__key")).select("f", "y")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """Score every row: `key`, `held_out`, `score` (0 to 1, higher: label 1 likelier), `predicted` (score >= 0.5).

    Only statistics of the text are inputs. Null and empty texts get the score of all-zero statistics; labels that are
    null or have no document are ignored; repeated rows each come back; without any label the score is 0.5.
    """
    stats = written(features(docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")), "__t", ("__k",)), "statistics")
    model = fit(training_rows(stats, labels, key, label), **options)
    scored = stats.select(F.col("__k").alias(key), held_out(F.col("__k")).alias("held_out"), scorer(model)("f").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def scorer(model: Model):
    """A column function from statistics to scores."""

    @F.pandas_udf(T.DoubleType())
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_numpy()).astype(float)) if len(f) else [], dtype=float)

    return score


def text_scorer(model: Model):
    """A column function from texts to scores."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        rows = [statistics(t.encode() if t else None).astype(np.float32) for t in text]
        return pd.Series(model.score(np.stack(rows).astype(float)) if rows else [], dtype=float)

    return score


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that score at least `threshold`.

    Texts are read twice: the labelled ones to fit, all to score. Labels of checked size are broadcast, so that only
    labelled texts reach the first pass; with more labels than that, the first pass takes the statistics of all texts, and
    only statistics are shuffled. Nulls, empty texts, repeated rows and tables without rows or labels: as in `classify`.
    """
    keyed = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    given = written(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key), F.col(label)), "labels")
    known = written(given.select(F.col(key).alias("__l")).distinct(), "labelled")
    if fits(known, 48):
        keyed = keyed.join(F.broadcast(known), F.col("__k") == F.col("__l"), "left_semi")
    stats = features(keyed, "__t", ("__k",))
    model = fit(training_rows(stats, given, key, label), **options)
    return docs.where(text_scorer(model)(F.col(text)) >= threshold)
