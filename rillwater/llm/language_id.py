"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents, its scores are calibrated by a temperature, and documents whose
calibrated score falls below a threshold are rejected. The threshold is set on
labelled rows left out of training, so that next to none of the correctly named ones
are lost. Prediction reads every whole text inside Spark tasks.

Defined results: a null text or one without any letter gets ``und``, score 0, and is
rejected. Without labelled rows every text gets ``und``. With one label every text
with letters gets it, score 1. Rows repeated or tied are scored alike; other columns
of the table take no part.
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

UNDETERMINED = "und"


@dataclass
class Settings:
    """``train_rows`` bounds the sample that is trained on (expected number of rows); up to half as many
    again give each label ``least_rows``, or all rows it has."""

    train_rows: int = 3000
    least_rows: int = 50
    buckets: int = 1 << 16
    dimension: int = 16
    sizes: tuple[int, int] = (2, 4)
    epochs: int = 3  # more on small samples, until there were least_steps
    least_steps: int = 240
    batch: int = 32
    learning_rate: float = 4.0
    lost_share: float = 0.0005
    highest_threshold: float = 0.5
    seed: int = 17


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float
    sizes: tuple[int, int]


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in re.finditer(r"[^\W\d_]", text))


def words_of(text: str) -> list[str]:
    return subwords.LETTERS.findall(text.lower())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Trains on four fifths of the rows, calibrates on the rest."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((1, len(languages)), np.float32), np.zeros(len(languages)), 1.0, 0.0, s.sizes)
    rng = np.random.default_rng(s.seed)
    target = np.array([languages.index(x) for x in labels])
    bags = subwords.hashed_counts(texts, words_of, s.sizes, s.buckets)
    order = rng.permutation([i for i, (hit, _) in enumerate(bags) if len(hit)])
    held, rest = order[:len(order) // 5], order[len(order) // 5:]
    embed = rng.normal(0, 0.1, (s.buckets, s.dimension)).astype(np.float32)
    out = rng.normal(0, 0.1, (s.dimension, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    per_epoch = max(1, -(-len(rest) // s.batch))
    epochs = max(s.epochs, -(-s.least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        rest = rng.permutation(rest)
        for at in range(0, len(rest), s.batch):
            chosen = rest[at:at + s.batch]
            used, where = np.unique(np.concatenate([bags[i][0] for i in chosen]), return_inverse=True)
            bag = np.zeros((len(chosen), len(used)), np.float32)
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            bag[row, where] = np.concatenate([bags[i][1] / bags[i][1].sum() for i in chosen])
            hidden = bag @ embed[used]
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(chosen)), target[chosen]] -= 1
            rate = s.learning_rate * (1 - step / steps)
            back = bag.T @ (error @ out.T)
            out -= rate / len(chosen) * (hidden.T @ error)
            bias -= rate / len(chosen) * error.sum(axis=0)
            # A subword's share of a document is small, so its row takes larger steps.
            embed[used] -= rate * back
            step += 1
    weights = embed @ out

    def logits(rows):
        return np.stack([(weights[bags[i][0]] * bags[i][1][:, None]).sum(axis=0) / bags[i][1].sum() + bias for i in rows])

    temperature, threshold = 1.0, 0.0
    if len(held):
        z, y = logits(held), target[held]
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(held)), y] + 1e-9).mean() for t in (0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.5)}
        temperature = min(losses, key=losses.get)
        p = _softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            threshold = min(float(np.quantile(right, s.lost_share)), s.highest_threshold)
    return Model(languages, weights.astype(np.float32), bias, temperature, threshold, s.sizes)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          settings: Settings | None = None) -> Model:
    """A model from a bounded sample, drawn by label, of the rows that have text and label."""
    s = settings or Settings()
    usable = labelled.where(col(label_col).isNotNull() & col(text_col).isNotNull())
    counts = usable.groupBy(col(label_col).alias("label")).agg(F.count("*").alias("n")).collect()  # a row for each class of the model
    n, chosen = sum(c["n"] for c in counts), usable
    if n > s.train_rows:
        # Rows of a label in proportion to its share, but as many as can be given to every label.
        least = min(s.least_rows, max(1, s.train_rows // (2 * len(counts))))
        share = [(c["label"], int((1 << 30) * min(1.0, max(s.train_rows / n, least / c["n"])))) for c in counts]
        wanted = usable.sparkSession.createDataFrame(share, "_label_ string, _share_ bigint")
        drawn = F.pmod(F.xxhash64(col(id_col)), F.lit(1 << 30)) < F.col("_share_")
        chosen = usable.join(F.broadcast(wanted), col(label_col).cast("string") == F.col("_label_")).where(drawn)
    # The sample is bounded by the parameter, whatever the number of rows.
    rows = sorted((r for r in chosen.select(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")).alias("k"),
                                            col(text_col).alias("t"), col(label_col).alias("y")).limit(2 * s.train_rows).collect()),
                  key=lambda r: (r["k"], r["t"]))
    return fit([r["t"] for r in rows], [r["y"] for r in rows], s)


def _score(table: subwords.WordTable, model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    count = len(model.languages)
    sums = np.zeros((len(texts), count + 1))
    flat: list[str] = []
    owners: list[tuple[int, int]] = []

    def settle() -> None:
        if flat:
            numbers = table.look_up(flat)
            rows = table.rows[numbers]
            lengths = np.array([n for _, n in owners])
            starts = np.cumsum(lengths) - lengths
            np.add.at(sums, [i for i, _ in owners], np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
        flat.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in subwords.pieces(text):
            words = words_of(piece)
            if words:
                flat.extend(words)
                owners.append((i, len(words)))
            if len(flat) > 500_000:
                settle()
    settle()
    has = np.array([has_letter(t) for t in texts], dtype=bool)
    if count == 0:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    p = _softmax((sums[:, :count] / np.maximum(sums[:, count:], 1) + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has)]
    return names, np.where(has, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, bounded by the settings
    threshold = model.threshold
    given = docs.select(*keep, col(text_col).alias("_text_"))
    schema = given.drop("_text_").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = subwords.WordTable(model.weights, model.sizes)
        for batch in batches:
            found, scores = [], []
            for group in subwords.in_batches(t.as_py() for t in batch.column(batch.num_columns - 1)):
                languages, score = _score(table, model, group)
                found += languages
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            rejected = [x == UNDETERMINED or y < threshold for x, y in zip(found, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score),
                                              pa.array(rejected, pa.bool_())], names=names)

    return small_batches(given).mapInArrow(run, schema)
