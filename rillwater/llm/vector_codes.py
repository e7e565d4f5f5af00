"""Vector code compression: a codebook for each part of the vectors, searched by Orchard's rule.

Vectors become integers (floor of ``scale`` times each component) and are cut into equal parts.
The codebook of a part starts as that part of the vectors with the smallest ids; every round assigns
all parts to their nearest entries and moves each entry to the floored mean of its parts.

Nearest entries are found by Orchard search: every entry has a list of the others by distance. A
search starts at some entry, walks along its list, and where an entry is nearer to the vector
jumps to that entry's list; entries are looked at once; the walk ends at the first neighbour
beyond twice the current distance, which the triangle inequality rules out with all that follow.
Neighbours at exactly twice the distance are looked at, as they may tie; ties go to the lower
index, so the result is that of comparing all entries. All searches of a batch walk side by side.

Spark scans the table once a round; tasks return one sum for each part and entry, so what
reaches the driver is bounded by the size of the codebooks.

Defined results: rows with a null vector or a null or non-finite component are dropped. The vectors'
length is the longest length rounded up to a multiple of the parts; shorter vectors count as ending in
zeros, an empty one as zeros only. Null ids come last, rows with one id are ordered by vector; rows
that repeat are vectors of their own. Fewer rows than entries give smaller codebooks, an empty table
gives no rows. Sums beyond 64 bits are an error, not a wrong number. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm.tables import col, small_batches, written
from rillwater.plans.keep import settle

LARGEST = 1 << 28  # integers up to this size cannot overflow in distances of parts of 2,048 components

BATCH_CELLS = 1 << 19

Books = list[np.ndarray]  # for each part an array of entries x components


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def integers(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of ``width`` integers from a list array without nulls."""
    ends = lists.offsets.to_numpy()
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled[ends[0]:ends[-1]]).max(initial=0) > LARGEST:
        raise OverflowError(f"components beyond {LARGEST / scale:g} cannot be coded")
    out = np.zeros((len(ends) - 1, width), np.int64)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)
    out[row, place] = scaled[ends[0]:ends[-1]].astype(np.int64)
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


class Orchard:
    """Nearest entries of a codebook by walks along sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = _squared(entries[:, None, :], entries[None, :, :])
        self.neighbours = np.argsort(between, axis=1, kind="stable")
        self.reach = np.take_along_axis(between, self.neighbours, axis=1)

    def nearest(self, rows: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) for each row, and how many distances were taken."""
        n, k = len(rows), len(self.entries)
        best = np.full(n, start)
        distance = _squared(rows, self.entries[start])
        visited = np.zeros((n, k), bool)
        visited[:, start] = True
        place = np.zeros(n, np.int64)
        walking, taken = np.arange(n), n
        while len(walking):
            inside = self.reach[best[walking], place[walking]] <= 4 * distance[walking]
            walking = walking[inside]
            other = self.neighbours[best[walking], place[walking]]
            place[walking] += 1
            new = ~visited[walking, other]
            rows_new, other = walking[new], other[new]
            visited[rows_new, other] = True
            found = _squared(rows[rows_new], self.entries[other])
            taken += len(found)
            better = (found < distance[rows_new]) | ((found == distance[rows_new]) & (other < best[rows_new]))
            jump = rows_new[better]
            best[jump], distance[jump], place[jump] = other[better], found[better], 0
            walking = walking[place[walking] < k]
        return best, distance, taken


def _assigned(vectors: np.ndarray, searches: Sequence[Orchard]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances (rows x parts)."""
    size = vectors.shape[1] // len(searches)
    found = [s.nearest(vectors[:, p * size:(p + 1) * size]) for p, s in enumerate(searches)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_CELLS`` components: a walk costs about the same for one row as for thousands."""
    held, cells = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            ends = batch.column(0).offsets
            cells += ends[-1].as_py() - ends[0].as_py() + batch.num_rows
        if cells >= BATCH_CELLS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, cells = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _width(df: DataFrame, vector_col: str, parts: int) -> int:
    longest = df.agg(F.max(F.size(col(vector_col)))).first()[0] or 0
    return max(1, -(-longest // parts)) * parts


def _moved(vectors: DataFrame, books: Books, scale: float) -> Books:
    """The codebooks after one round over the column ``v``."""
    parts, size = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in _gathered(batches):
            rows = integers(batch.column(0), parts * size, scale)
            index, _ = _assigned(rows, searches)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                used, starts, number = np.unique(index[order, p], return_index=True, return_counts=True)
                sums[p][used] += np.add.reduceat(rows[order, p * size:(p + 1) * size], starts, axis=0)
                counts[p][used] += number
        at = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p])]
        if at:
            where = [np.repeat([x[i] for x in at], size).astype(np.int32) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[0]), pa.array(where[1]), pa.array(np.tile(np.arange(size, dtype=np.int32), len(at))),
                 pa.array(np.concatenate([sums[p][e] for p, e in at])), pa.array(np.repeat([counts[p][e] for p, e in at], size).astype(np.int64))],
                names=["part", "entry", "place", "total", "number"])

    partial = vectors.mapInArrow(run, "part int, entry int, place int, total bigint, number bigint")
    exact = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("number").alias("number"))
    moved = [b.copy() for b in books]
    for r in exact.collect():  # one row for each integer of the codebooks
        moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["number"]
    return moved


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6,
          scale: float = 4096.0) -> Books:
    """The codebooks of all usable vectors; an empty list if there are none."""
    kept = df.where(usable(col(vector_col)))
    width = _width(kept, vector_col, parts)
    vectors = kept.select(col(vector_col).cast("array<double>").alias("v"))
    first = kept.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    start = [r["v"] for r in first.collect()]
    if not start:
        return []
    table = integers(pa.array(start, pa.list_(pa.float64())), width, scale)
    size = width // parts
    books = [table[:, p * size:(p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _moved(vectors, books, scale)
    return books


def digest(books: Books) -> str:
    """SHA-256 of all integers of the codebooks in order of part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: Books, keep: Sequence[Column], vector_col: str = "embedding", scale: float = 4096.0) -> DataFrame:
    """``keep`` of every usable vector with its code (an index for each part) and error."""
    given = df.where(usable(col(vector_col))).select(col(vector_col).cast("array<double>").alias("v"), F.struct(*keep).alias("row"))
    kind = given.schema["row"].dataType.simpleString()
    if not books:
        return given.select("row.*", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(b) for b in books]
        width = sum(b.shape[1] for b in books)
        for batch in _gathered(batches):
            index, distance = _assigned(integers(batch.column(0), width, scale), searches)
            ends = pa.array(np.arange(len(index) + 1, dtype=np.int32) * len(books))
            codes = pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), codes, pa.array(distance.sum(axis=1))], names=["row", "code", "error"])

    coded = small_batches(given).mapInArrow(run, f"row {kind}, code array<int>, error bigint")
    return coded.select("row.*", "code", "error")


def decode(code: Sequence[int], books: Books, scale: float = 4096.0) -> list[float]:
    """The vector that a code stands for: the middles of its entries' integer cells."""
    return [(float(x) + 0.5) / scale for p, e in enumerate(code) for x in books[p][e]]


def code_text(code: Column) -> Column:
    """Two lower-case hexadecimal digits for each index."""
    return F.array_join(F.transform(code, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """Codes with their errors, the errors of all vectors of the same label, and a digest of the codebooks."""
    books = train(df, id_col, vector_col, **settings)
    given = encode(df, books, [col(id_col).alias("id"), col(label_col).alias("label")], vector_col, settings.get("scale", 4096.0))
    coded = written(given.select("id", "label", code_text(F.col("code")).alias("code"), "error"), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    sums = settle(sums.select(F.col("label").alias("same_label"), "label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same_label")))
    return joined.select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
