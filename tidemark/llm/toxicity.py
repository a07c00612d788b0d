"""Toxicity by non-negative positive-unlabelled learning.

The confirmed toxic rows and a sample of unlabelled texts train a linear classifier with the class-prior
corrected risk: prior * E+[loss(g)] + max(0, E_u[loss(-g)] - prior * E+[loss(-g)]). Where the second part
falls below zero its gradient is reversed, so the classifier cannot fit the unlabelled texts away. Features are
words and word beginnings; a text's margin is the sum of its different words' weights over a root of their number. A
two-parameter logistic fit on labelled rows turns margins into scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Generations, small_batches, spread
from tidemark.llm.labelled import SAMPLE_ROWS, held_out, logistic, sample_ids, sample_texts, sigmoid

BEGINNINGS = (3, 4, 5, 6)
FEATURES = 600
LENGTH_POWER = 0.25
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


_words = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> set[str]:
    """The different words, split at ASCII white space as split() does for a column."""
    return set(_words.findall(text))


def word_features(word: str) -> list[str]:
    bare = word.lower().strip(EDGES)
    return [bare + "$", *(bare[:k] for k in BEGINNINGS if len(bare) >= k)] if bare else []


def pu_gradient(x_pos: np.ndarray, x_all: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk (logistic loss) of weights w, and the gradient to follow."""
    g_pos, g_all = x_pos @ w, x_all @ w
    s_pos, s_all = sigmoid(g_pos) / len(g_pos), sigmoid(g_all) / len(g_all)
    positive = prior * np.logaddexp(0, -g_pos).mean()
    negative = np.logaddexp(0, g_all).mean() - prior * np.logaddexp(0, g_pos).mean()
    to_positive = -prior * (x_pos.T @ (1 / len(g_pos) - s_pos))
    to_negative = x_all.T @ s_all - prior * (x_pos.T @ s_pos)
    if negative < 0:
        return positive, -to_negative
    return positive + negative, to_positive + to_negative


@dataclass
class ToxicModel:
    weights: dict[str, float]
    offset: float
    slope: float
    bias: float

    def word_weights(self, words: list[str]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in word_features(w)) for w in words]


def margins(words: pa.Array, bounds: np.ndarray, weigh) -> np.ndarray:
    """Per text: the weights of its different words over a power of their number; 0 without words."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    weights = np.array(weigh(coded.dictionary.to_pylist()) or [0.0], float)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.unique(text * size + coded.indices.to_numpy().astype(np.int64))
    n = np.bincount(pairs // size, minlength=len(bounds) - 1)
    return np.bincount(pairs // size, weights[pairs % size], minlength=len(bounds) - 1) / np.maximum(n, 1) ** LENGTH_POWER


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)


def matrix(texts: list[str], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(index) + 1))
    for i, t in enumerate(texts):
        words = words_of(t)
        for w in words:
            for f in word_features(w):
                if (k := index.get(f)) is not None:
                    x[i, k] += 1
        x[i, :-1] /= max(1, len(words)) ** LENGTH_POWER
    x[:, -1] = 1
    return x


def fit(positive: list[str], unlabelled: list[str], labelled: list[str], toxic: np.ndarray, prior: float, steps: int = 400) -> ToxicModel:
    """prior is the share of toxic texts; with no positive rows every text scores the prior."""
    base = math.log((prior + 1e-6) / (1 - prior + 1e-6))
    if not positive or not unlabelled or not labelled:
        return ToxicModel({}, 0.0, 0.0, base)
    df_pos, df_all = Counter(), Counter()
    for texts, df in ((positive, df_pos), (unlabelled, df_all)):
        for t in texts:
            df.update({f for w in words_of(t) for f in word_features(w)})
    gain = {
        f: n * math.log((n / len(positive)) / ((df_all[f] + 0.5) / len(unlabelled)))
        for f, n in df_pos.items() if n >= 3
    }
    chosen = sorted((f for f in gain if gain[f] > 0), key=lambda f: (-gain[f], f))[:FEATURES]
    index = {f: k for k, f in enumerate(chosen)}
    x_pos, x_all = matrix(positive, index), matrix(unlabelled, index)
    scale = np.r_[np.maximum(np.sqrt((x_all[:, :-1] ** 2).mean(axis=0)), 0.02), 1.0]
    x_pos, x_all = x_pos / scale, x_all / scale
    w = np.zeros(len(index) + 1)
    w[-1] = base
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam
        _, g = pu_gradient(x_pos, x_all, w, prior)
        g = g + 1e-4 * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = {f: float(w[k] / scale[k]) for f, k in index.items() if w[k]}
    model = ToxicModel(weights, float(w[-1]), 1.0, 0.0)
    words, bounds = split(pa.array(labelled, pa.large_string()))
    margin = margins(words, bounds, model.word_weights) + model.offset
    model.slope, model.bias = (float(v) for v in logistic(np.c_[margin, np.ones(len(margin))], toxic.astype(float)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Fit on at most `rows` toxic, `rows` other labelled and 2 * `rows` unlabelled texts, none of them held out."""
    known = labels.where("doc_id is not null and toxic is not null")
    share = known.where(~held_out()).agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0] or 0.0
    toxic_ids, other_ids = sample_ids(known.where("toxic > 0"), rows), sample_ids(known.where("toxic = 0"), rows)
    free_ids = sample_ids(docs, 2 * rows)
    texts = sample_texts(docs, toxic_ids + other_ids + free_ids)
    by_id = dict(zip(texts["doc_id"], texts["text"], strict=True))
    pick = lambda ids: [by_id[i] for i in ids if i in by_id]
    positive, other = pick(toxic_ids), pick([i for i in other_ids if i not in set(toxic_ids)])
    # both kinds are sampled apart: weigh the calibration back to the true share by repeating the larger kind's part
    keep = min(len(other), round(len(positive) * (1 - share) / share)) if share and positive else len(other)
    part = min(len(positive), max(1, round(len(other) * share / (1 - share)))) if 0 < share < 1 and other else len(positive)
    marks = np.r_[np.ones(part), np.zeros(keep)]
    return fit(positive, pick(free_ids), positive[:part] + other[:keep], marks, float(share))


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null text counts as empty; empty texts score by the bias."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        cache = Generations(model.word_weights)
        for batch in batches:
            words, bounds = split(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            p = sigmoid(model.slope * (margins(words, bounds, cache.many) + model.offset) + model.bias)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return spread(own).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on the labels and score every row; repeated rows repeat, other columns are ignored, empty stays empty."""
    return score(docs, train(docs, labels), threshold)
