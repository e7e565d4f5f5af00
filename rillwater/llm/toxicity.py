"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, a window the words in it. The vectors of a
window's subwords are averaged and go through a linear softmax; the most toxic window of
a document gives its score, so a few words are not drowned in a long text. Embeddings and
output layer are trained jointly by gradient descent in numpy on a bounded sample of
labelled documents: the labels are those of whole documents, and each step goes through
the windows that decide them. Misspellings that never occurred in training share n-grams
with words that did. Scores are calibrated by a logistic curve on rows left out of training.

Defined results: a null or empty text, or one without words, gets the calibrated score of
"nothing found". Without labelled rows, or with one label only, every score is the share of
toxic labels (0 without labels). Rows repeated or tied are scored alike; other columns of the
table take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm import subwords
from rillwater.llm.tables import col, small_batches

# Letters, digits and the signs that stand for letters in disguised spellings.
WORD = re.compile(r"[\w@$*]+")
LOOKALIKES = str.maketrans("013457@$", "oieastas")


@dataclass
class Settings:
    """``train_rows`` bounds the sample that is trained on (expected number of rows)."""

    train_rows: int = 7000
    buckets: int = 1 << 17
    dimension: int = 8
    sizes: tuple[int, int] = (3, 5)
    window: int = 1
    epochs: int = 8
    batch: int = 64
    learning_rate: float = 0.5
    smoothing: float = 0.5
    seed: int = 23


@dataclass
class Model:
    weights: np.ndarray  # bucket x 1: log-odds that a subword adds
    slope: float
    offset: float
    base: float  # score where no window is
    sizes: tuple[int, int]
    window: int


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain_spelling(word: str) -> str:
    """Signs that stand for letters become those letters, in words that have letters."""
    return word.translate(LOOKALIKES) if not word.isalpha() and any(c.isalpha() for c in word) else word


def window_scores(rows: np.ndarray, window: int) -> np.ndarray:
    """Average over the subwords of the runs of 1 to ``window`` words from each word on."""
    total = rows.astype(np.float64)
    found = np.full((len(rows), window), -np.inf)
    found[:, 0] = total[:, 0] / total[:, 1]
    for k in range(1, min(window, len(rows))):
        total[:-k] += rows[k:]
        found[:-k, k] = total[:-k, 0] / total[:-k, 1]
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small pull on the slope."""
    at, scale = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - at) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(30):
        p = _sigmoid(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (p - y) + 0.05 * w)
    return w[0] / scale, w[1] - w[0] * at / scale


def _buckets_by_word(words: list[str], s: Settings, group: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, one word after the other, and how many each has."""
    buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), group):
        part = words[at:at + group]
        owner, bucket = subwords.subword_buckets([plain_spelling(w) for w in part], s.sizes, s.buckets)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(sizes)


def fit(texts: list[str], labels: list[int], s: Settings) -> Model:
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros((1, 1), np.float32), 0.0, np.log((share + 1e-9) / (1 - share + 1e-9)), share, s.sizes, s.window)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held, rest = order[:len(y) // 4], order[len(y) // 4:]
    # Presence of each bucket in documents of either label starts the first dimension.
    seen = np.zeros((2, s.buckets))
    known: dict[str, int] = {}
    numbers = [np.array([known.setdefault(w, len(known)) for piece in subwords.pieces(t) for w in words_of(piece)], np.int32)
               for t in texts]
    bucket, size = _buckets_by_word(list(known), s)
    first = np.cumsum(size) - size

    def buckets_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, one after the other, and how many each has."""
        n = size[numbers]
        at = np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return bucket[at], n

    for i in rest:
        if len(numbers[i]):
            seen[int(y[i]), np.unique(buckets_of(np.unique(numbers[i]))[0])] += 1
    count = np.bincount(y[rest].astype(int), minlength=2)
    small = max(1, count.min())
    odds = np.log((seen[1] * small / max(1, count[1]) + s.smoothing) / (seen[0] * small / max(1, count[0]) + s.smoothing))
    embed = rng.normal(0, 0.02, (s.buckets, s.dimension)).astype(np.float32)
    embed[:, 0] = odds
    out = np.zeros(s.dimension, np.float32)
    out[0] = 1
    bias = -2.0

    def best_windows(chosen, word_sums):
        """The words of the most toxic window of each document, and its average."""
        spans, top = [], []
        for i in chosen:
            if not len(numbers[i]):
                spans.append(numbers[i])
                top.append(0.0)
                continue
            scores = window_scores(np.column_stack([word_sums[numbers[i]], size[numbers[i]]]), s.window)
            start, more = divmod(int(scores.argmax()), s.window)
            spans.append(numbers[i][start:start + more + 1])
            top.append(scores[start, more])
        return spans, np.array(top)

    def sums():
        return np.add.reduceat((embed @ out)[bucket], first)

    for epoch in range(s.epochs):
        word_sums = sums()
        rest = rng.permutation(rest)
        spans, _ = best_windows(rest, word_sums)
        rate = s.learning_rate * (1 - epoch / s.epochs)
        for at in range(0, len(rest), s.batch):
            chosen, parts = rest[at:at + s.batch], spans[at:at + s.batch]
            found = [buckets_of(p)[0] for p in parts]
            lengths = np.array([len(f) for f in found])
            used = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(chosen)), lengths)
            share = 1.0 / np.maximum(lengths, 1)
            hidden = np.zeros((len(chosen), s.dimension))
            np.add.at(hidden, row, embed[used] * share[row][:, None])
            # Both classes weigh the same, however rare one is.
            weight = np.where(y[chosen] == 1, 0.5 * len(rest) / max(1, count[1]), 0.5 * len(rest) / max(1, count[0]))
            error = (_sigmoid(hidden @ out + bias) - y[chosen]) * weight
            bias -= rate * float(error.mean())
            np.subtract.at(embed, used, (rate * (error * share)[row])[:, None] * out[None, :])
            out -= (rate * (hidden * error[:, None]).mean(axis=0)).astype(np.float32)
    _, top = best_windows(held, sums())
    slope, offset = _logistic(top, y[held])
    if slope <= 0:  # nothing was learned
        slope, offset = 0.0, float(np.log(y.mean() / (1 - y.mean())))
    return Model((embed @ out)[:, None].astype(np.float32), slope, offset,
                 float(_sigmoid(np.array(offset))), s.sizes, s.window)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          settings: Settings | None = None) -> Model:
    """A model from a bounded sample of the documents that have text and a label of 0 or 1.

    The labels that take part are chosen by a hash of the id before they meet the texts; of
    an id labelled more than once every label counts.
    """
    s = settings or Settings()
    usable = labels.where(col(label_col).isin(0, 1)).select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"))
    texts = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("t"))
    n = usable.join(texts.select("id"), "id", "left_semi").count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, s.train_rows / max(n, 1)))
    rows = texts.where(share).join(usable.where(share), "id").select("t", "y").limit(2 * s.train_rows)
    found = sorted((r["t"], r["y"]) for r in rows.toLocalIterator())
    return fit([t for t, _ in found], [y for _, y in found], s)


def _score(table: subwords.WordTable, model: Model, texts: list[str]) -> np.ndarray:
    top = np.full(len(texts), -np.inf)
    for i, text in enumerate(texts):
        before: list[str] = []
        for piece in subwords.pieces(text):
            words = before + words_of(piece)
            if words:
                numbers = table.look_up(words)
                top[i] = max(top[i], window_scores(table.rows[numbers], model.window).max())
                # Windows may reach over the cut between two pieces.
                before = words[len(words) - model.window + 1:] if model.window > 1 else []
    found = np.isfinite(top)
    return np.where(found, _sigmoid(model.slope * np.where(found, top, 0) + model.offset), model.base)


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket, bounded by the settings
    given = docs.select(*keep, col(text_col).alias("_text_"))
    schema = given.drop("_text_").withColumn("score", F.lit(0.0)).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = subwords.WordTable(model.weights, model.sizes, plain_spelling)
        for batch in batches:
            groups = subwords.in_batches(t.as_py() for t in batch.column(batch.num_columns - 1))
            found = [_score(table, model, g) for g in groups]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found) if found else np.zeros(0))],
                                             names=names)

    return small_batches(given).mapInArrow(run, schema)
