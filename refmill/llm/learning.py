"""What the two label-fitted operators share: the split, the bounded sample, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most, for each class. A documented bound: the models have few parameters.
FIT_ROWS_PER_CLASS = 10_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``: decides who is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def fit_sample(labels: DataFrame, label: str, parts: int, held: int, rows: int = FIT_ROWS_PER_CLASS) -> tuple[DataFrame, float, float]:
    """(doc_id, label, weight) of at most ``rows`` training documents a class, and the training rows of each class.

    Held-out rows and null labels never enter; a document with several labels counts as its largest.
    Rows are taken by a hash of their id, so reruns agree.
    """
    train = labels.filter((remainder(F.col("doc_id"), parts) != held) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    taken = [train.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("weight", F.lit(max(1.0, n.get(y, 0) / rows))) for y in (0, 1)]
    return taken[0].unionByName(taken[1]), float(n.get(0, 0)), float(n.get(1, 0))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg)
        b = b + np.linalg.solve(h, x.T @ (w * (y - p)) - reg * b)
    return b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, value) of the best non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, v, u in zip(x[order], y[order], w[order], strict=True):
        blocks.append([a, a, v * u, u])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            low, high, total, weight = blocks.pop()
            blocks[-1][1:] = [high, blocks[-1][2] + total, blocks[-1][3] + weight]
    at = np.array([v for b in blocks for v in (b[0], b[1])])
    value = np.repeat([(b[2] + 0.5) / (b[3] + 1.0) if b[2] in (0, b[3]) else b[2] / b[3] for b in blocks], 2)
    return at, np.maximum.accumulate(value)
