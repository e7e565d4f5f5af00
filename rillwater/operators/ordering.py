"""Positions in a defined order, and the train/test layouts cut from them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwater.plans.keep import settle, store

# Fixed by Spark: monotonically_increasing_id holds the partition above this bit.
_PARTITION_SHIFT = 33
MARK = "_mark"


@dataclass(frozen=True)
class SortedTable:
    """Rows stored in order, addressable by position without numbering them.

    ``rows`` holds a mark made of sorted partition and place in it; ``starts``
    the first position of every partition. A position range thus becomes a range
    of marks, which the parquet reader can use to skip row groups.
    """

    rows: DataFrame
    starts: tuple[tuple[int, int], ...]  # (partition, first position), ascending
    n_rows: int

    def mark_of(self, position: int) -> int:
        """Mark of the row at a position; positions past the end give an upper limit."""
        if position >= self.n_rows:
            return (self.starts[-1][0] + 1 << _PARTITION_SHIFT) if self.starts else 0
        at = bisect_right([s for _, s in self.starts], position) - 1
        part, start = self.starts[at]
        return (part << _PARTITION_SHIFT) + position - start

    def slice(self, first: int, end: int) -> DataFrame:
        """Rows at positions first..end-1."""
        return self.rows.where((F.col(MARK) >= self.mark_of(first))
                               & (F.col(MARK) < self.mark_of(end))).drop(MARK)

    def block(self, cuts: Sequence[int]) -> Column:
        """How many of the ascending cut positions a row has reached."""
        chain = F.lit(0)
        for number, cut in enumerate(cuts, start=1):
            chain = F.when(F.col(MARK) >= self.mark_of(cut), number).otherwise(chain)
        return chain

    def numbered(self, name: str = "row_idx") -> DataFrame:
        """The rows with their position as a column."""
        part = F.shiftright(F.col(MARK), _PARTITION_SHIFT)
        spark = self.rows.sparkSession
        # One row per sorted partition: as many as the sort had tasks.
        starts = settle(spark.createDataFrame(list(self.starts), "_part bigint, _start bigint"))
        place = F.col(MARK) - F.shiftleft(F.col("_part"), _PARTITION_SHIFT)
        return (self.rows.withColumn("_part", part).join(starts, "_part")
                .withColumn(name, F.col("_start") + place).drop("_part", "_start", MARK))


def sort_rows(df: DataFrame, order: Sequence[str | Column]) -> SortedTable:
    """Sort across all tasks and store the result once.

    The range sort also spreads the rows of one hot date, as long as the order
    has a tie-break. Range bounds are sampled and may differ when recomputed, so
    the sorted rows are written before anything is counted on them.
    """
    marked = df.orderBy(*order).withColumn(MARK, F.monotonically_increasing_id())
    kept = store(marked, "sorted")
    part = F.shiftright(F.col(MARK), _PARTITION_SHIFT).alias("part")
    starts, n_rows = [], 0
    for number, size in sorted((r["part"], r["size"]) for r in kept.groupBy(part).agg(
            F.count("*").alias("size")).collect()):
        starts.append((number, n_rows))
        n_rows += size
    return SortedTable(kept, tuple(starts), n_rows)


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_idx") -> DataFrame:
    """Number rows 0..n-1 in the given order without a single-task window."""
    return sort_rows(df, order).numbered(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    return (df.groupBy(*keys).agg(F.min(packed).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                      for c in df.columns]))


@dataclass(frozen=True)
class Fold:
    """Rows [0, train_end) train, rows [test_start, test_end) test."""

    fold: int
    train_end: int
    test_start: int
    test_end: int


def forward_folds(n_rows: int, splits: int) -> list[Fold]:
    """Forward chaining: each test block follows all rows it is predicted from."""
    if splits < 2:
        raise ValueError("at least two splits are needed")
    size = n_rows // (splits + 1)
    if size == 0:
        raise ValueError(f"{n_rows} rows are too few for {splits} splits")
    return [Fold(i + 1, n_rows - (splits - i) * size, n_rows - (splits - i) * size,
                 n_rows - (splits - i - 1) * size) for i in range(splits)]


def fold_layout(table: SortedTable, splits: int, date: str) -> DataFrame:
    """Per fold: row ranges and dates of the training and the test part.

    One scan counts blocks; folds are nested, so the rest is a running sum over
    splits + 1 rows.
    """
    folds = forward_folds(table.n_rows, splits)
    blocks = table.rows.groupBy(table.block([f.test_start for f in folds]).alias("fold")).agg(
        F.count("*").alias("n_test"),
        F.min(date).alias("first_test_date"), F.max(date).alias("last_test_date"))
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("n_train", F.sum("n_test").over(before))
            .withColumn("last_train_date", F.max("last_test_date").over(before))
            .where(F.col("fold") > 0)
            .select("fold", "n_train", "last_train_date", F.col("n_train").alias("test_start"),
                    "n_test", "first_test_date", "last_test_date"))


def layout_ranges(table: SortedTable, splits: int) -> DataFrame:
    """The layout as ranges (fold, part, first, last), as drawn in a split chart.

    Counted on the rows: sizes of the blocks between the cuts, added up over splits + 1 rows.
    """
    cuts = [f.test_start for f in forward_folds(table.n_rows, splits)]
    blocks = table.rows.groupBy(table.block(cuts).alias("fold")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = blocks.withColumn("stop", upto).withColumn("start", F.col("stop") - F.col("n")).where(F.col("fold") > 0)
    ranges = F.array(F.struct(F.lit("train").alias("part"), F.lit(0).cast("bigint").alias("first"), (F.col("start") - 1).alias("last")),
                     F.struct(F.lit("test").alias("part"), F.col("start").alias("first"), (F.col("stop") - 1).alias("last")))
    return ends.select("fold", F.explode(ranges).alias("r")).select("fold", "r.*")


def shuffled_fold(key: Sequence[str], folds: int, seed: int = 42) -> Column:
    """Fold 1..k of a row by the hash of its key: same rows, same folds, no shuffle."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(folds)) + 1).cast("int")


def digest_fold(key: Sequence[str], folds: int) -> Column:
    """Fold 1..k of a row by the MD5 digest of its key, which other engines can compute too."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return (F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(folds)) + 1).cast("int")


def holdout_part(index: Column, n_rows: int, test_share: float = 0.2) -> Column:
    """``test`` for the last share of the ordered rows, else ``train``."""
    n_test = -int(-(n_rows * test_share) // 1)
    return F.when(index >= n_rows - n_test, "test").otherwise("train")
