"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its score comes from its own features and those of the lines before and
after it; a transition table joins neighbours. Training maximises the conditional likelihood of a bounded sample
in which each line has its document's label. Scoring runs forward-backward over all lines of a document and
averages the marginals of 'good', weighted by line length; a logistic fit turns that average into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_whole_rows, small_batches, spread
from tidemark.llm.labelled import SAMPLE_ROWS, held_out, logistic, sample_ids, sample_texts, sigmoid

SLICE_BYTES = 4_000_000
_upper, _lower, _digit, _space, _stop, _mark, _high = (1 << k for k in range(7))


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = _high
        elif c.isspace() and b < 33:
            table[b] = _space
        elif c.isalpha():
            table[b] = _upper if c.isupper() else _lower
        elif c.isdigit():
            table[b] = _digit
        elif c in ".,;:?'\"()-":
            table[b] = _stop
        else:
            table[b] = _mark
    return table


CLASS_OF = _classes()
OWN = 12


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of every line, and each text's bounds among the lines. An empty text is one line."""
    lines = pc.split_pattern(texts, "\n")
    bounds = (lines.offsets.to_numpy() - lines.offsets[0].as_py()).astype(np.int64)
    flat = lines.flatten()
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    data = np.frombuffer((b"\n".join(flat.cast(pa.large_binary()).to_pylist()) if len(flat) else b"") + b"\n", np.uint8)
    kinds = CLASS_OF[data]
    starts = np.r_[0, np.cumsum(size + 1)[:-1]] if len(size) else np.zeros(0, np.int64)
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    space = kinds == _space
    ends = ~space & np.r_[space[1:], True]  # last bytes of words
    marked = ends & (kinds == _mark)
    words = count(ends)
    upper, lower, digit, stop, mark, high = (count(kinds == k) for k in (_upper, _lower, _digit, _stop, _mark, _high))
    split = pc.ascii_split_whitespace(flat)
    tokens = split.flatten()
    offsets = (split.offsets.to_numpy() - split.offsets[0].as_py()).astype(np.int64)
    codes = tokens.dictionary_encode().indices.to_numpy()
    again = np.r_[False, codes[1:] == codes[:-1]] if len(codes) else np.zeros(0, bool)
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    again[firsts] = False
    repeats = np.diff(np.r_[0, np.cumsum(again)][offsets])
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    x = np.zeros((len(size), OWN))
    letters = np.maximum(upper + lower, 1)
    for k, column in enumerate(
        (np.log1p(size) / 8, upper / letters, mark / n, digit / n, stop / n, count(marked) / w, repeats / w,
         np.minimum(size / w, 30) / 10, high / n, size < 40, (upper / letters > 0.6) & (words > 1), (count(marked) / w > 0.3))
    ):
        x[:, k] = column
    return x, size, bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a one; missing neighbours are zeros."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(emission: np.ndarray, transition: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transition counts, over chains emission[bounds[k]:bounds[k+1]].

    Chains advance together, one line a step. States are (bad, good); a bad line scores 0.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    start, size = bounds[:-1][order], sizes[order]
    local = np.exp(np.stack([np.minimum(0, -emission), np.minimum(0, emission)], axis=1))
    move = np.exp(transition - transition.max())
    forward, backward = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(longest):
        at = start[: active[t]] + t
        a = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    last = start + size - 1
    backward[last] = 1
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = (local[at + 1] * backward[at + 1]) @ move.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    joint = forward * backward
    good = joint[:, 1] / joint.sum(axis=1)
    inner = np.ones(len(emission), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    pair = forward[i][:, :, None] * move[None] * (local[i + 1] * backward[i + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


@dataclass
class QualityModel:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    bias: float

    def means(self, texts: pa.Array) -> np.ndarray:
        """Length-weighted marginals; an empty text takes that of its one empty line."""
        x, size, bounds = line_features(texts)
        if not len(x):
            return np.zeros(0)
        good, _ = marginals(with_neighbours(x, bounds) @ self.weights, self.transition, bounds)
        weight = size + 1e-6
        return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])

    def scores(self, texts: pa.Array) -> np.ndarray:
        m = np.clip(self.means(texts), 1e-6, 1 - 1e-6)
        return sigmoid(self.slope * np.log(m / (1 - m)) + self.bias)


def fit(texts: list[str], good: np.ndarray, steps: int = 150, l2: float = 1e-3) -> QualityModel:
    """With labels of one kind, or none, every text scores that kind's share (0.5 for none)."""
    share = float(good.mean()) if len(good) else 0.5
    width = 3 * OWN + 1
    if not len(good) or not 0 < share < 1:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    column = pa.array(texts, pa.large_string())
    x, size, bounds = line_features(column)
    x = with_neighbours(x, bounds)
    lines = np.diff(bounds)
    y = np.repeat(good.astype(float), lines)
    weight = np.repeat(1 / lines, lines)  # documents count alike
    same = np.zeros((2, 2))
    np.add.at(same, (good.astype(int), good.astype(int)), lines - 1)
    w, move = np.zeros(width), np.zeros((2, 2))
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):  # Adam
        p, pairs = marginals(x @ w, move, bounds)
        g = np.r_[-(x.T @ ((y - p) * weight)) / len(texts) + l2 * w, ((pairs - same) / max(1, (lines - 1).sum()) + l2 * move).ravel()]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, move = theta[:width], np.clip(theta[width:].reshape(2, 2), -2, 2)
    model = QualityModel(w.copy(), move.copy(), 1.0, 0.0)
    m = np.clip(model.means(column), 1e-6, 1 - 1e-6)
    model.slope, model.bias = (float(v) for v in logistic(np.c_[np.log(m / (1 - m)), np.ones(len(m))], good.astype(float)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most 2 * `rows` labelled texts, none of them held out."""
    known = labels.where("doc_id is not null and quality is not null")
    ids = sample_ids(known, 2 * rows)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    marks = known.join(wanted, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality")).toPandas()
    texts = sample_texts(docs, ids).merge(marks, on="doc_id")
    return fit(texts["text"].tolist(), (texts["quality"] > 0).to_numpy())


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null text counts as empty."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sliced_scores(sent.value, batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return spread(own).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def sliced_scores(model: QualityModel, texts: pa.Array) -> np.ndarray:
    """Scores of a batch, a bounded number of bytes at once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sums = np.cumsum(pc.binary_length(texts).to_numpy())
    out, at = [np.zeros(0)], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE_BYTES)))
        out.append(model.scores(texts.slice(at, end - at)))
        at = end
    return np.concatenate(out)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Train on the labels and score every row; repeated rows repeat, other columns are ignored, empty stays empty."""
    return score(docs, train(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever their names.

    A null text counts as an empty one, which scores by the model's bias alone, and stays null. Rows with a null id
    are scored like others; rows that repeat stay or go alike; without labels all texts score the same. An empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return map_whole_rows(spread(docs), lambda batch: batch.filter(pa.array(sliced_scores(sent.value, batch.column("text")) >= threshold)))
