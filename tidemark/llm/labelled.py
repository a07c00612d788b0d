"""Bounded samples of labelled texts, and the calibration that the two classifiers share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: rows of a kind, and characters of a text that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from; a null id is not among them and has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample_ids(rows: DataFrame, n: int) -> list[int]:
    """At most n ids that may be learned from, in an order that does not depend on the table's size."""
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


def sample_texts(docs: DataFrame, ids: list[int]) -> pd.DataFrame:
    """doc_id and text of those ids, one row an id; longer texts than SAMPLE_CHARS are not learned from."""
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in set(ids)], "doc_id long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(wanted, "doc_id").where(F.char_length("text") <= SAMPLE_CHARS)
    first = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    return first.toPandas().sort_values("doc_id").reset_index(drop=True)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by damped Newton steps; the last column should be ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
