"""Ranked lexical search: a K2-treap over the grid of terms and documents.

Documents are taken in blocks as they are read; nothing is shuffled. A block is a grid whose rows
are its terms, the strongest first, and whose columns are its documents in order of their ids. The
filled cells hold impacts (what one unit of a term's weight adds to a document's score). Quartering
the grid again and again gives a compressed quadtree: only cells that hold something are there, a
cell with one filled quarter is left out, and every cell keeps the largest impact inside.

An item starts at the whole grid and follows the rows of all its terms at once, best first: for a
range of documents the sum of its terms' weights, each times the maximum of the cell that the
term's row and the range share, bounds the score of every document inside. Ranges with the
highest bounds are halved next, many items and ranges in one step of numpy; a range of one document
has its exact score. A range is given up once its bound is below the score that the wanted number
of documents has already reached, in this block or an earlier one of the task; equal scores are
kept, so ties are exact.

Three passes: counts of documents and terms over all texts; the index, one row a block, its arrays compressed
where they are made, stored in the shared folder; the search. The number of documents that hold a term comes from the index. Items
are taken ``ITEM_TERMS`` terms at a time, so that what a task is sent is bounded whatever the number of
items. Each block returns at most ``top`` rows an item, ranked by a window that cuts before its shuffle.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z lowered;
they are told apart by 64-bit hashes.

Defined results: null and empty texts have no terms, count for nothing and are never found; an item
without terms finds nothing. Documents that repeat are documents of their own; equal scores are ordered by
id, null ids last. Items that repeat are ranked each for itself. Empty tables give no rows. Other
columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwater.llm.shingles import word_hashes
from rillwater.llm.tables import col, small_batches, written
from rillwater.plans.keep import scratch

BLOCK_DOCS = 2048
BLOCK_CHARS = 4 << 20
ITEM_TERMS = 500_000  # terms of items that are searched in one pass
ITEMS_AT_ONCE = 16
RANGES_AT_ONCE = 256
IMPACT_UNIT = 1_000_000_000

TERM_BYTES = np.zeros(256, bool)  # ASCII letters and digits, and all bytes of characters beyond ASCII
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    TERM_BYTES[ord(_first):ord(_last) + 1] = True
TERM_BYTES[128:] = True


def terms_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts end to end, and how many each text has."""
    return word_hashes(texts, TERM_BYTES)


def _texts(column: pa.Array) -> list[str]:
    return [t.as_py() or "" for t in column]


def corpus_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents with repeats)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = terms_of(_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["documents", "terms"])

    counted = small_batches(docs.select(col(text_col).alias("t"))).mapInArrow(run, "documents bigint, terms bigint")
    found = counted.agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight; ``length`` is the number of terms of the document."""
    spread = 50 + (50 * length * documents) // max(terms, 1)
    return (IMPACT_UNIT * tf) // (1000 * tf + 20 * spread)


def weight(holders: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


# ---------------------------------------------------------------- the tree of a block

def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, each followed by a zero bit."""
    x = x.astype(np.int64)
    for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << step)) & mask
    return x


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of binary digits."""
    return np.frexp(x.astype(np.float64))[1] * (x > 0)


def build_tree(place: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Compressed quadtree over sorted distinct places (interleaved row and column bits).

    Cells are numbered from the root down, the quarters of a cell next to each other. Of each: ``place``
    of its first filled leaf, ``level`` (its side is 2^level), ``most``, and the number of its first
    quarter and which quarters (bits) are there.
    """
    n = len(place)
    apart = (_bits(place[1:] ^ place[:-1]) + 1) // 2  # level at which neighbours meet; places stay below 2^53
    starts, levels, most = [place], [np.zeros(n, np.int64)], [value]
    children: dict[int, np.ndarray] = {}
    now, total = np.arange(n), n
    made = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]  # first member, members, level of each inner cell
    members: list[np.ndarray] = []
    value_of = value
    place_of = place
    for level in range(1, int(apart.max(initial=0)) + 1):
        joined = apart <= level
        if not joined.any():
            continue
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        size = np.diff(np.append(first, len(now)))
        inner = size > 1
        best = np.maximum.reduceat(value_of, first)
        number = now[first].copy()
        number[inner] = total + np.arange(inner.sum())
        inside = np.repeat(inner, size)
        members.append(now[inside])
        made.append((number[inner], size[inner], np.full(inner.sum(), level)))
        starts.append(place_of[first][inner])
        levels.append(np.full(inner.sum(), level))
        most.append(best[inner])
        total += int(inner.sum())
        now, value_of, place_of = number, best, place_of[first]
        apart = apart[~joined]
    starts, levels, most = np.concatenate(starts), np.concatenate(levels), np.concatenate(most)
    child = np.concatenate([*members, np.zeros(0, np.int64)])
    size = np.concatenate([np.zeros(n, np.int64), *[m[1] for m in made]])
    at = np.cumsum(size) - size
    # Numbers from the root down.
    order, row = [now], now
    while len(row):
        row = row[size[row] > 0]
        if len(row):
            reps = size[row]
            row = child[np.repeat(at[row] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
            order.append(row)
    order = np.concatenate(order)
    new = np.empty(total, np.int64)
    new[order] = np.arange(total)
    firsts = np.zeros(total, np.int64)
    inner = np.flatnonzero(size > 0)
    firsts[inner] = new[child[at[inner]]]
    quarters = np.zeros(total, np.int64)
    owner = np.repeat(inner, size[inner])
    np.bitwise_or.at(quarters, owner, 1 << ((starts[child] >> (2 * (levels[owner] - 1))) & 3))
    return {"place": starts[order], "level": levels[order].astype(np.uint8), "most": most[order].astype(np.int32),
            "first": firsts[order].astype(np.int32), "quarters": quarters[order].astype(np.uint8)}


def build_block(hashes: np.ndarray, counts: np.ndarray, documents: int, terms: int) -> dict[str, np.ndarray]:
    """The index of documents in order of their ids: row hashes, holders of each row, and the tree."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(doc)))
    hashes, doc = hashes[first], doc[first]
    value = impacts(tf.astype(np.int64), counts[doc].astype(np.int64), documents, terms)
    words, start, held = np.unique(hashes, return_index=True, return_counts=True)
    # The strongest rows first, so that cells hold rows of like impact and bounds are tight.
    strength = np.maximum.reduceat(value, start) if len(start) else np.zeros(0, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -held, -strength))] = np.arange(len(words))
    place = (_spread(np.repeat(rank, held)) << 1) | _spread(doc)
    order = np.argsort(place)
    return {"word": words.view(np.int64), "held": held.astype(np.int32), "rank": rank.astype(np.int32), **build_tree(place[order], value[order])}


# ---------------------------------------------------------------- search in a block

class Block:
    def __init__(self, arrays: dict[str, np.ndarray], columns: int):
        self.word, self.rank = arrays["word"].view(np.uint64), arrays["rank"]
        self.place, self.most = arrays["place"], arrays["most"]
        # First quarter, level and quarters of a cell in one number, as they are looked up together.
        self.cell = (arrays["first"].astype(np.int64) << 16) | (arrays["level"].astype(np.int64) << 8) | arrays["quarters"]
        # The number of lower quarters that are there, by quarters and quarter.
        self.before = np.array([bin(q & ((1 << k) - 1)).count("1") for q in range(16) for k in range(4)])
        self.height = int(max(columns, len(self.word), 2) - 1).bit_length()

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Spread row numbers of term hashes, -1 where the block has no such term."""
        at = np.minimum(np.searchsorted(self.word, words), max(len(self.word) - 1, 0))
        there = self.word[at] == words if len(self.word) else np.zeros(len(words), bool)
        return np.where(there, _spread(self.rank[at]) << 1 if len(self.word) else -1, -1)

    def down(self, cell: np.ndarray, row: np.ndarray, column: np.ndarray, level: int) -> np.ndarray:
        """The cells that hold what is left of cells one level higher in the quarters of side 2^level; -1 where nothing is."""
        wanted = (row | column) >> (2 * level)
        quarter = wanted & 3
        found = self.cell[cell]
        branch = (found >> 8) & 255 == level + 1
        there = (found >> quarter) & 1 == 1
        chain = np.flatnonzero(~branch)
        there[chain] = (self.place[cell[chain]] >> (2 * level)) == wanted[chain]
        child = (found >> 16) + self.before[((found & 15) << 2) | quarter]
        child[chain] = cell[chain]
        child[~there] = -1
        return child

    def search(self, item: np.ndarray, word: np.ndarray, weights: np.ndarray, items: int, top: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, column, score) of the best documents; entries of ``item`` are sorted. ``reached`` holds scores known to be met."""
        row = self.rows(word)
        use = (row >= 0) & (weights > 0)
        item, row, weights = item[use], row[use], weights[use]
        done_item, done_column, done_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        best = [np.zeros(0, np.int64) for _ in range(items)]
        floor = reached.copy()
        if not len(item):
            return done_item[0], done_column[0], done_score[0]
        # Open ranges, with their entries (one for each term that has a cell there) next to each other.
        owners, size = np.unique(item, return_counts=True)
        opened = {"item": owners, "column": np.zeros(len(owners), np.int64), "level": np.full(len(owners), self.height),
                  "bound": np.bincount(np.searchsorted(owners, item), weights * self.most[0], len(owners)).astype(np.int64), "size": size}
        entries = {"cell": np.zeros(len(item), np.int64), "row": row, "weight": weights}
        while len(opened["item"]):
            order = np.lexsort((opened["column"], -opened["bound"], opened["item"]))
            place = np.empty(len(order), np.int64)
            sorted_items = opened["item"][order]
            starts = np.searchsorted(sorted_items, sorted_items)
            place[order] = np.arange(len(order)) - starts
            chosen = place < RANGES_AT_ONCE
            at = np.cumsum(opened["size"]) - opened["size"]

            def taken(which: np.ndarray) -> np.ndarray:
                reps = opened["size"][which]
                return np.repeat(at[which] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())

            rest = np.flatnonzero(~chosen)
            kept_ranges = [{k: v[rest] for k, v in opened.items()}]
            kept_entries = [{k: v[taken(rest)] for k, v in entries.items()}]
            picked = np.flatnonzero(chosen)
            for level in np.unique(opened["level"][picked]):
                part = picked[opened["level"][picked] == level]
                own = taken(part)
                range_of = np.repeat(np.arange(len(part)), opened["size"][part])
                half = 1 << (int(level) - 1)
                above, rows, weight_of = entries["cell"][own], entries["row"][own], entries["weight"][own]
                for side in (0, 1):
                    column = opened["column"][part] + side * half
                    cell = self.down(above, rows, _spread(column)[range_of], int(level) - 1)
                    there = cell >= 0
                    cell, owner, power = cell[there], range_of[there], weight_of[there]
                    size = np.bincount(owner, minlength=len(part))
                    bound = np.zeros(len(part), np.int64)
                    some = np.flatnonzero(size)
                    bound[some] = np.add.reduceat(power * self.most[cell], (np.cumsum(size) - size)[some]) if len(some) else 0
                    alive = (size > 0) & (bound > 0) & (bound >= floor[opened["item"][part]])
                    if level == 1:
                        who, where, score = opened["item"][part][alive], column[alive], bound[alive]
                        done_item.append(who)
                        done_column.append(where)
                        done_score.append(score)
                        for i in np.unique(who):
                            best[i] = np.sort(np.concatenate([best[i], score[who == i]]))[-top:]
                            if len(best[i]) == top:
                                floor[i] = max(floor[i], best[i][0])
                    else:
                        mine = alive[owner]
                        kept_ranges.append({"item": opened["item"][part][alive], "column": column[alive], "level": np.full(int(alive.sum()), level - 1),
                                            "bound": bound[alive], "size": size[alive]})
                        kept_entries.append({"cell": cell[mine], "row": rows[there][mine], "weight": power[mine]})
            opened = {k: np.concatenate([r[k] for r in kept_ranges]) for k in opened}
            entries = {k: np.concatenate([e[k] for e in kept_entries]) for k in entries}
            hopeless = opened["bound"] < floor[opened["item"]]
            if hopeless.any():
                stay = np.repeat(~hopeless, opened["size"])
                entries = {k: v[stay] for k, v in entries.items()}
                opened = {k: v[~hopeless] for k, v in opened.items()}
        done_item, done_column, done_score = np.concatenate(done_item), np.concatenate(done_column), np.concatenate(done_score)
        order = np.lexsort((done_column, -done_score, done_item))
        done_item = done_item[order]
        nth = np.arange(len(order)) - np.searchsorted(done_item, done_item)
        order = order[nth < top]
        return done_item[nth < top], done_column[order], done_score[order]


# ---------------------------------------------------------------- Spark

ARRAYS = {"word": np.int64, "held": np.int32, "rank": np.int32, "place": np.int64, "level": np.uint8, "most": np.int32, "first": np.int32, "quarters": np.uint8}


def packed(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed, behind their number: what the JVM holds of a block, several times over, is a third of it."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(value: pa.BinaryScalar, kind: type) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd"), kind)


def build_index(docs: DataFrame, counts: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents: ids in order, and the arrays of the tree as compressed bytes."""
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("t"))
    kind = given.schema["id"].dataType.simpleString()
    documents, terms = counts

    def made(ids: list[pa.Array], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        key = pa.chunked_array(ids).combine_chunks()
        hashed, count = np.concatenate(hashes), np.concatenate(sizes)
        order = pc.sort_indices(key, null_placement="at_end").to_numpy()
        at = (np.cumsum(count) - count)[order]
        reps = count[order]
        hashed = hashed[np.repeat(at - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
        arrays = build_block(hashed, reps, documents, terms)
        key = key.take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key)
        return pa.RecordBatch.from_arrays([lists, *[pa.array([packed(arrays[k].astype(v))], pa.binary()) for k, v in ARRAYS.items()]], names=["ids", *ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sizes, chars, rows = [], [], [], 0, 0
        for batch in batches:
            at = 0
            texts = _texts(batch.column(1))
            while at < len(texts):
                end, more = at, 0
                while end < len(texts) and rows + end - at < BLOCK_DOCS and chars + more < BLOCK_CHARS:
                    more += len(texts[end])
                    end += 1
                hashed, count = terms_of(texts[at:end])
                some = count > 0  # documents without terms are never found
                ids.append(batch.column(0).slice(at, end - at).filter(pa.array(some)))
                hashes.append(hashed)
                sizes.append(count[some])
                rows, chars, at = rows + end - at, chars + more, end
                if rows >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    if sum(map(len, hashes)):
                        yield made(ids, hashes, sizes)
                    ids, hashes, sizes, chars, rows = [], [], [], 0, 0
        if sum(map(len, hashes)):
            yield made(ids, hashes, sizes)

    schema = f"ids array<{kind}>, " + ", ".join(f"{k} binary" for k in ARRAYS)
    return small_batches(given).mapInArrow(run, schema)


def _stored(index: DataFrame) -> DataFrame:
    """The index in the shared folder. Its rows are megabytes each, so the writer looks at their size after every one and keeps
    no least and greatest values, which are whole rows that it would hold until its file ends."""
    path = scratch(index.sparkSession, "treaps")
    index.write.options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20),
                           "parquet.column.statistics.enabled": "false", "parquet.size.statistics.enabled": "false",
                           "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
                           "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def holders(index: DataFrame, words: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the sorted term hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, held in zip(batch.column(0), batch.column(1)):
                own = unpacked(word, np.int64).view(np.uint64)
                there = np.isin(own, words)
                yield pa.RecordBatch.from_arrays([pa.array(own[there].view(np.int64)), pa.array(unpacked(held, np.int32)[there].astype(np.int64))],
                                                 names=["word", "held"])

    found = index.select("word", "held").mapInArrow(run, "word bigint, held bigint").groupBy("word").agg(F.sum("held").alias("n"))
    return {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in found.collect()}  # at most as many rows as words


def _item_groups(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items with their distinct terms, so many at a time that their terms stay below ``ITEM_TERMS`` (one item at least)."""
    names, words, size = [], [], 0
    for r in items.select(col(item_col).alias("i"), col(text_col).alias("t")).toLocalIterator():
        own = np.unique(terms_of([r["t"] or ""])[0])
        if names and size + len(own) > ITEM_TERMS:
            yield names, words
            names, words, size = [], [], 0
        names.append(r["i"])
        words.append(own)
        size += len(own)
    if names:
        yield names, words


def search_index(index: DataFrame, names: list, words: list[np.ndarray], documents: int, top: int) -> DataFrame:
    """(nth, id, score): the best documents of each block for each item, by its place in ``names``."""
    all_words = np.unique(np.concatenate(words))
    held = holders(index, all_words)
    weights = [np.array([weight(held[int(w)], documents) if int(w) in held else 0 for w in own], np.int64) for own in words]
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                block = Block({k: unpacked(batch.column(n + 1)[i], kind) for n, (k, kind) in enumerate(ARRAYS.items())}, len(ids))
                for at in range(0, len(names), ITEMS_AT_ONCE):
                    group = range(at, min(at + ITEMS_AT_ONCE, len(names)))
                    reached = np.array([met[g][0] if len(met[g]) == top else 0 for g in group], np.int64)
                    item = np.repeat(np.arange(len(group)), [len(words[g]) for g in group])
                    who, column, score = block.search(item, np.concatenate([words[g] for g in group]), np.concatenate([weights[g] for g in group]),
                                                      len(group), top, reached)
                    for k in np.unique(who):
                        met[at + k] = np.sort(np.concatenate([met[at + k], score[who == k]]))[-top:]
                    yield pa.RecordBatch.from_arrays([pa.array((who + at).astype(np.int32)), ids.take(pa.array(column)), pa.array(score)], names=["nth", "id", "score"])

    return index.select("ids", *ARRAYS).mapInArrow(run, f"nth int, id {kind}, score bigint")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         top: int = 50) -> DataFrame:
    """(item, rank, id, score): for each item its best documents with a score above 0."""
    spark = docs.sparkSession
    counts = corpus_counts(docs, text_col)
    index = _stored(build_index(docs, counts, id_col, text_col))
    item_type = items.schema[item_col].dataType
    found = None
    for names, words in _item_groups(items, item_col, item_text_col):
        best = search_index(index, names, words, counts[0], top)
        order = Window.partitionBy("nth").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(names)), f"nth int, item {item_type.simpleString()}")  # at most ITEM_TERMS rows, or one
        best = written(best.join(named, "nth").select("item", "rank", "id", "score"), "ranked")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item {item_type.simpleString()}, rank int, id {docs.schema[id_col].dataType.simpleString()}, score bigint")
    return found
