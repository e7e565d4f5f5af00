"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so its size
follows the document, unions and intersections of fingerprints are those of the documents'
sets below the fraction, and containment can be estimated between very unequal documents.
Documents with few hashes there keep their ``floor`` smallest ones; what a fingerprint covers
is written in it, and a comparison uses the range that both cover. Texts of at most ``floor``
shingles are kept whole and compared exactly.

As text a fingerprint is ``<range>:<hashes>``: the covered range in hexadecimal (all hashes
below it are there) and the sorted hashes, 8 bytes each, in base 64.

Defined results: a null text counts as empty; texts without words have no hashes and are alike
(1) to each other and not (0) to any other. Equal texts have equal fingerprints. Rows that repeat
follow each other; ids that tie are ordered by text; null ids come last in descending order. An
empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm.shingles import distinct, shingle_hashes
from rillwater.llm.tables import col, shuffle_partitions, small_batches

FRACTION = 1 / 16
FLOOR = 64
WORDS = 5
RANGE = 1 << 64
GROUP_CHARS = 1 << 20
BLOCKS_PER_PARTITION = 4

Sketch = tuple[int, np.ndarray]


def sketch(hashes: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> Sketch:
    """(covered range, hashes below it) of a sorted set of hashes."""
    if len(hashes) <= floor:
        return RANGE, hashes
    limit = max(int(RANGE * fraction), int(hashes[floor]))
    return limit, hashes[:np.searchsorted(hashes, np.uint64(limit))]


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The fingerprint of both documents together."""
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both if limit == RANGE else both[:np.searchsorted(both, np.uint64(limit))]


def _counts(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    limit = min(a[0], b[0])
    x, y = (s[1] if limit == RANGE else s[1][:np.searchsorted(s[1], np.uint64(limit))] for s in (a, b))
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity."""
    x, y, shared = _counts(a, b)
    return 1.0 if x + y == 0 else shared / (x + y - shared)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; 1 where a has none in the covered range."""
    x, _, shared = _counts(a, b)
    return shared / x if x else 1.0


def to_text(s: Sketch) -> str:
    return f"{s[0]:x}:" + base64.b64encode(s[1].astype("<u8").tobytes()).decode()


def from_text(text: str) -> Sketch:
    limit, _, data = text.partition(":")
    return int(limit, 16), np.frombuffer(base64.b64decode(data), "<u8")


def sketches_of(texts: list[str], words: int = WORDS, fraction: float = FRACTION, floor: int = FLOOR) -> list[Sketch]:
    return [sketch(s, fraction, floor) for s in distinct(*shingle_hashes(texts, words))]


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", words: int = WORDS, fraction: float = FRACTION,
                 floor: int = FLOOR) -> DataFrame:
    """``keep`` columns and the fingerprint of every row."""
    given = docs.select(*keep, col(text_col).alias("_text_"))
    schema = given.drop("_text_").withColumn("fingerprint", F.lit("")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for group in _groups([t.as_py() or "" for t in batch.column(batch.num_columns - 1)]):
                found += [to_text(s) for s in sketches_of(group, words, fraction, floor)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=names)

    return small_batches(given).mapInArrow(run, schema)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _block_number(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are above the key; found in two short searches."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds[::width]])
    chunks = F.array(*[F.array(*[F.lit(b) for b in bounds[i:i + width]]) for i in range(0, len(bounds), width)])
    coarse = F.size(F.filter(every, lambda b: b <= key))
    inside = F.when(coarse > 0, F.size(F.filter(F.get(chunks, coarse - 1), lambda b: b <= key))).otherwise(0)
    below = F.greatest(coarse - 1, F.lit(0)) * width + inside
    return F.lit(len(bounds)) - below


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, text, guest) with blocks that follow each other in descending order of ids.

    Block limits are quantiles of the ids, a few for each shuffle partition. Each block also has, as
    guest, the document that follows its last one: the first of the next block that is not empty, and
    after the very last the first of all. Only limits and first ids, one for each block, meet on the driver.
    """
    spark = docs.sparkSession
    number = BLOCKS_PER_PARTITION * shuffle_partitions(spark)
    given = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    shares = [i / number for i in range(1, number)]
    bounds = given.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", shares, 0.25 / number) if shares else []
    blocks = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_block_number(F.col("doc_id"), sorted({int(b) for b in bounds})))
    dealt = given.withColumn("block", blocks.cast("int"))
    firsts = sorted((r["block"], r["first"]) for r in dealt.groupBy("block").agg(F.max("doc_id").alias("first")).collect())
    if not firsts:
        return dealt.select("block", "doc_id", "text", F.lit(False).alias("guest"))
    before = spark.createDataFrame([(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)], "first bigint, block int")
    own = dealt.withColumn("guest", F.lit(False))
    candidates = given.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first")))
    # Of tied ids the one that is first in its block is the guest.
    guests = candidates.groupBy("block", "doc_id").agg(F.min("text").alias("text")).withColumn("guest", F.lit(True))
    return own.select("block", "doc_id", "text", "guest").unionByName(guests.select("block", "doc_id", "text", "guest"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, fraction: float = FRACTION,
                    floor: int = FLOOR) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike those and neighbours are.

    The edited text has its last third replaced by the start of the next document's. Documents
    are shuffled once, by block, and each task reads its block in order.
    """
    blocks = in_blocks(docs, id_col, text_col)
    number = shuffle_partitions(docs.sparkSession)
    dealt = blocks.repartition(number, "block").sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, in_edited double")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (block, id, text, guest), the last of them without successor yet

        def compared(rows: list[tuple]) -> pa.RecordBatch | None:
            """Rows for all but the last, which has no successor here."""
            pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][3]]
            if not pairs:
                return None
            texts = [r[2] for r in rows]
            edited = {k: texts[k][:len(texts[k]) - len(texts[k]) // 3] + texts[k + 1][:len(texts[k]) // 3] for k in pairs}
            own = sketches_of(texts, words, fraction, floor)
            new = dict(zip(edited, sketches_of(list(edited.values()), words, fraction, floor)))
            columns = [[rows[k][1] for k in pairs], [len(texts[k]) for k in pairs],
                       [hashlib.sha256(edited[k].encode()).hexdigest() for k in pairs],
                       [to_text(own[k]) for k in pairs], [to_text(new[k]) for k in pairs],
                       [likeness(own[k], new[k]) for k in pairs], [likeness(own[k], own[k + 1]) for k in pairs],
                       [containment(own[k], new[k]) for k in pairs]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

        size = 0
        for batch in batches:
            block, key, text, guest = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                waiting.append((block[i].as_py(), key[i].as_py(), text[i].as_py(), guest[i].as_py()))
                size += len(waiting[-1][2])
                if size >= GROUP_CHARS and len(waiting) > 1:
                    if out := compared(waiting):
                        yield out
                    waiting = waiting[-1:]
                    size = 0
        if out := compared(waiting):
            yield out

    return small_batches(dealt).mapInArrow(run, schema)
