"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

* ``statistics_of`` turns a whole text into a short vector of ratios.
* ``FEATURES`` random cosines of the standardised vector approximate a Gaussian kernel between such vectors.
* Each partition of labelled rows sums its own part of the normal equations; parts are added row by row of the matrix.  The
  driver only sees the finished (FEATURES + 1)^2 system and a histogram of at most ``BINS`` calibration scores, whose sizes
  don't depend on the data.
* Ridge is fitted on four fifths of the learning rows; on the other fifth, pool-adjacent-violators over the histogram turns
  raw scores into probabilities.

Null texts count as empty and get the score of the empty vector.  Rows of ``labels`` with a null id or label teach nothing;
several labels of one document all count.  Without any label to learn from every score is 1: nothing speaks against a text.
Very long texts are measured whole.  Rows that repeat are scored, and where labelled teach, each for itself; equal statistics
get equal scores.  An empty table gives no rows.  Extra columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import store

FEATURES = 256
RIDGE = 1.0
BINS = 3001
SEED = 20240601
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~=_\\{}[]+/"
EXCLAIM = b"!?"
POINTS = b".,;:'\"()-"
HIGH = bytes(range(128, 256))
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "exclaim", "points", "high", "distinct",
    "top_share", "top5_share", "adjacent_equal", "log_lines", "duplicate_lines", "words_per_line", "capitalised", "symbol_words",
)


def statistics_of(text: str | None) -> list[float]:
    """The vector of ``NAMES`` for a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    size, n = len(raw), len(words)
    if not n:
        return [float(np.log1p(size))] + [0.0] * (len(NAMES) - 1)

    def share(kind: bytes) -> float:
        return (size - len(raw.translate(None, kind))) / size

    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:5]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = share(UPPER), share(LOWER)
    capitals = sum(k for w, k in counts.items() if 65 <= w[0] <= 90)
    marked = sum(k for w, k in counts.items() if w[-1] in SYMBOLS or w[0] in SYMBOLS)
    return [
        float(np.log1p(size)), float(np.log1p(n)), sum(map(len, words)) / n, upper / max(upper + lower, 1e-9), share(DIGITS),
        share(SYMBOLS), share(EXCLAIM), share(POINTS), share(HIGH), len(counts) / n, top[0] / n, sum(top) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, float(np.log1p(len(lines))), 1 - len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))), capitals / n, marked / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics_of(x.as_py()) for x in texts], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the ridge; empty without labels
    at: np.ndarray  # raw scores and the probabilities they stand for
    probability: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.ones(len(stats))
        return np.clip(np.interp(self.raw(stats), self.at, self.probability), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised vectors, with a constant; the kernel's width is the root of their length."""
    rng = np.random.default_rng(SEED)
    d = len(NAMES)
    frequencies = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    cosines = np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -6, 6) @ frequencies + phases)
    return np.hstack([cosines, np.ones((len(z), 1))])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % 4 == 2, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """A model from (doc_id, stats) and (doc_id, quality); held-out rows teach nothing."""
    labels = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("y"))
    rows = measured.join(labels, F.col("doc_id") == F.col("_labelled")).filter(~held_out(F.col("doc_id")))
    rows = rows.withColumn("calibrates", F.floor(fold(F.col("doc_id")) / 4) % 5 == 0).select("stats", "y", "calibrates")
    teach, check = rows.filter(~F.col("calibrates")), rows.filter("calibrates")
    columns = [f(F.get("stats", F.lit(i))).alias(f"{n}{i}") for i in range(len(NAMES)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = teach.agg(F.count("*").alias("n"), *columns).first()
    empty = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.empty(0), np.empty(0), np.empty(0))
    if not sums["n"]:
        return empty
    mean = np.array([sums[f"m{i}"] for i in range(len(NAMES))])
    scale = np.array([sums[f"s{i}"] or 0.0 for i in range(len(NAMES))])
    scale[scale < 1e-9] = 1.0
    shape = Model(mean, scale, np.empty(0), np.empty(0), np.empty(0))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = shape.features(matrix(batch.column("stats")))
            total += x.T @ np.hstack([x, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "part": [np.sum(np.stack(group["part"].to_list()), axis=0)]})

    summed = teach.mapInArrow(parts, "i int, part array<double>").groupBy("i").applyInPandas(added, "i int, part array<double>")
    system = np.stack([np.asarray(r["part"]) for r in sorted(summed.collect(), key=lambda r: r["i"])])
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    fitted = Model(mean, scale, weights, np.empty(0), np.empty(0))

    @F.arrow_udf(T.DoubleType())
    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(fitted.raw(matrix(stats)))

    bins = F.least(F.greatest(F.floor(raw("stats") * 1000 + 1000), F.lit(0)), F.lit(BINS - 1))
    histogram = check.groupBy(bins.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    if not histogram:
        return Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, probability = isotonic(sorted((r["bin"], r["n"], r["ones"]) for r in histogram))
    return Model(mean, scale, weights, at, probability)


def isotonic(bins: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin, rows, rows with label 1) in order; the middles of the pools and their shares."""
    pools: list[list[float]] = []  # [sum of bin * rows, rows, ones]
    for b, n, ones in bins:
        pools.append([b * n, n, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    at = np.array([s / n for s, n, _ in pools]) / 1000 - 1
    return at + 0.0005, np.array([ones / n for _, n, ones in pools])


def scorer(model: Model):
    """A column function statistics -> score."""

    @F.arrow_udf(T.DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(stats)))

    return score


def text_scorer(model: Model):
    """A column function text -> score, for filters that keep the text."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics_of(x.as_py()) for x in texts]).reshape(-1, len(NAMES))))

    return score


def measure(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, stats) of every whole text."""
    store.bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("stats"))
