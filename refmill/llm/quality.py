"""Document quality: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every text gives one vector of statistics (lengths, character classes, repetition). For a bounded sample of
labelled rows they are scaled and mapped to random Fourier features, which approximate a Gaussian kernel; each
partition sums its part of the normal equations, in two folds, and the sums of the partitions are solved for
ridge weights. Scores of each fold by the other fold's weights give the isotonic curve that turns a score into
a probability.

Edge cases: a null or empty text has statistics of 0; without labels of both classes every score is the share of
ones (0.5 if there are none); repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .learning import fit_sample, isotonic, remainder

WAVES = 256
RIDGE = 1.0
SEED = 7
THRESHOLD = 0.3
FIT_PARTITIONS = 16

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "letters", "capitals", "digits", "blanks", "breaks", "stops", "bars", "shouts", "symbols", "quotes_and_braces", "beyond_ascii",
    "distinct_words", "top_word", "distinct_pairs", "log_lines", "line_length", "repeated_lines", "ends_with_sign", "capital_words", "short_words",
)
_KIND = np.zeros(256, dtype=np.int64)
for _n, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:", b"|", b"!?", b"#$%&*@^~+=<>_\\/", b"\"'`(){}[]", bytes(range(128, 256))), 1):
    _KIND[list(_set)] = _n


def statistics(text: str | None) -> list[float]:
    """One number for each of ``STATISTICS``."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    k = np.bincount(_KIND[raw], minlength=12)[1:] / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    signs = sum(w[-1] in "#$%&*!?|" for w in words) / n
    capital = sum(w[0].isupper() for w in words) / n
    return [
        np.log(len(raw)), np.log(n), lengths.mean(), lengths.std(), np.log(lengths.max()), k[0] + k[1], k[1], k[2], k[3], k[4], k[5], k[6], k[7], k[8], k[9], k[10],
        len(counts) / n, max(counts.values()) / n, pairs, np.log(len(lines)), np.log(np.mean([len(x) for x in lines])), 1 - len(set(lines)) / len(lines), signs, capital, (lengths <= 2).mean(),
    ]


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.waves + self.phase
        return np.column_stack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.weights):
            return np.full(len(x), self.value[0])
        return np.clip(np.interp(self.lifted(x) @ self.weights, self.at, self.value), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch[column]], dtype=np.float64).reshape(-1, len(STATISTICS))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch, "text")
        yield pa.record_batch([batch["fold"], batch["label"], batch["weight"], pa.array(list(x), pa.list_(pa.float64()))], names=["fold", "label", "weight", "x"])


def _normal(model: Model):
    """One row a partition and fold: the sums of weight * z z' and weight * z y, flat."""
    d = len(model.phase) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((2, d, d)), np.zeros((2, d))
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            y, w, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold"))
            z = model.lifted(x)
            for f in (0, 1):
                m = fold == f
                gram[f] += (z[m] * w[m, None]).T @ z[m]
                right[f] += z[m].T @ (w[m] * y[m])
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([g.ravel() for g in gram], pa.list_(pa.float64())), pa.array(list(right), pa.list_(pa.float64()))], names=["fold", "gram", "right"])

    return run


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> Model:
    """From at most ``FIT_ROWS_PER_CLASS`` labelled rows of each class that aren't held out."""
    sample, n0, n1 = fit_sample(labels, "quality", parts, held)
    none = np.array([])
    share = Model(none, none, none, none, none, none, np.array([n1 / (n0 + n1) if n0 + n1 else 0.5]))
    if not n0 or not n1:
        return share
    # the sample's ids are bounded by two classes of FIT_ROWS_PER_CLASS
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))
    rows = stored(rows.select("fold", "label", "weight", "text").mapInArrow(_measure, "fold int, label int, weight double, x array<double>"), "quality-sample").coalesce(FIT_PARTITIONS)
    got = rows.toPandas()  # bounded by the sample's size
    if got["label"].nunique() < 2 or got["fold"].nunique() < 2:
        return share
    x = np.array(got["x"].tolist(), dtype=float)
    rng = np.random.default_rng(SEED)
    spread = np.maximum(x.std(axis=0), 1e-6)
    waves = rng.normal(size=(x.shape[1], WAVES)) / np.sqrt(x.shape[1])
    model = Model(x.mean(axis=0), spread, waves, rng.uniform(0, 2 * np.pi, WAVES), none, none, share.value)
    d = WAVES + 1
    sums = rows.mapInArrow(_normal(model), "fold int, gram array<double>, right array<double>").toPandas()  # two rows for each of FIT_PARTITIONS
    total = {f: (sum((np.array(v) for v in g["gram"]), np.zeros(d * d)).reshape(d, d), sum((np.array(v) for v in g["right"]), np.zeros(d))) for f, g in sums.groupby("fold")}
    solve = lambda *folds: np.linalg.solve(sum(total[f][0] for f in folds) + RIDGE * np.eye(d), sum(total[f][1] for f in folds))
    z, fold = model.lifted(x), got["fold"].to_numpy()
    raw = np.where(fold == 0, z @ solve(1), z @ solve(0))
    at, value = isotonic(raw, got["label"].to_numpy(float), got["weight"].to_numpy(float))
    return model._replace(weights=solve(0, 1), at=at, value=value)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and a score from 0 to 1 of each row's text; a kept column named ``score`` is replaced."""
    keep = tuple(c for c in dict.fromkeys(keep) if c != "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch[f"kept{i}"] for i in range(len(keep))] + [pa.array(model.score(_matrix(batch, "text")), pa.float64())], names=[*keep, "score"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "score double"
    return docs.select(*(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)), "text").mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
