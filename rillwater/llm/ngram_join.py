"""Near duplicates: a self-join on the Jaccard similarity of word n-gram sets.

1. Every document becomes a set of shingle hashes; equal sets are one node. MinHash values are
   cut into bands whose number and width are chosen for a target recall at the threshold.
2. Nodes are shuffled on their band hashes. Each node is tied to the smallest node of its
   buckets, and what is tied together is a candidate cluster: no pairs are listed, and every
   two nodes that share a bucket are in one cluster.
3. Clusters are verified on full n-gram sets in blocks of bounded size: nodes of a cluster are
   grouped by set size (sets that differ more than the threshold allows never meet) and dealt
   over blocks, and each pair of blocks is one group of a shuffle. A group counts the links of
   its nodes and returns one edge a node, never all pairs.
4. Components of the verified edges are the classes.

Links are exact for all pairs that meet in a cluster; a pair at the threshold is missed with
the probability that ``band_shape`` was asked for, more similar pairs with less.

Defined results: a null text counts as empty; texts without words are equal to each other (similarity
1) and to nothing else. Equal sets count as links. The smallest id of a class names it (null ids
are larger than all others). Rows that repeat are documents of their own. An empty table gives
no rows. Other columns take no part. Nodes are told apart by 64 bits of their sets' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.llm import sieve
from rillwater.llm.components import components
from rillwater.llm.shingles import _mix, distinct, shingle_hashes
from rillwater.llm.tables import col, shuffle_partitions, small_batches, written

GROUP_CHARS = 1 << 20
BLOCK_NODES = 256
BLOCK_SHINGLES = 400_000
MATRIX_CELLS = 1 << 23


def band_shape(threshold: float, recall: float, most_hashes: int = 400) -> tuple[int, int]:
    """(bands, rows): the widest bands with which a pair at the threshold shares one with the asked probability."""
    for rows in range(most_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows)) if threshold ** rows > 1e-12 else most_hashes + 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _node_of(found: np.ndarray) -> int:
    """64 bits that tell a set of hashes."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(_mix(found * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64) + np.uint64(len(found))
    return int(_mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketches(docs: DataFrame, shape: tuple[int, int], words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, node, shingles, bands) of every document."""
    bands, rows = shape
    given = docs.select(col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("text_hash"), col(text_col).alias("t"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, text_hash bigint, node bigint, shingles bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(5)
        factors = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        turns = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        weights = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            nodes, sizes, hashed = [], [], [np.zeros((0, bands), np.int64)]
            for group in _groups(batch.column(2)):
                hashes, counts = shingle_hashes(group, words)
                for found in distinct(hashes, counts):
                    nodes.append(_node_of(found))
                    sizes.append(len(found))
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                totals = np.zeros((len(counts), bands), np.uint64)
                for k in range(bands * rows if len(full) else 0):
                    least = np.minimum.reduceat((low ^ turns[k]) * factors[k], starts)
                    totals[full, k // rows] += (least.astype(np.uint64) + np.uint64(1)) * weights[k]
                hashed.append(_mix(totals + weights[:bands]).view(np.int64))
            table = np.concatenate(hashed)
            # A text without words shares no band with any other.
            values = pa.array(table.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * bands), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists],
                                             names=["id", "text_hash", "node", "shingles", "bands"])

    return small_batches(given).mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) from (t); hashes are sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch.column(0)):
                sets = list(distinct(*shingle_hashes(group, words)))
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_node_of(s) for s in sets], pa.int64()), lists], names=["node", "hashes"])

    return small_batches(docs).mapInArrow(run, "node bigint, hashes array<bigint>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    both = np.concatenate([*left, *right])
    words, number = np.unique(both, return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    times = np.bincount(number, minlength=len(words))
    # Shingles of every set are counted at once, those of one set never meet; in between by matrix product.
    everywhere = times == len(sizes)
    used = np.flatnonzero((times > 1) & ~everywhere)
    place = np.full(len(words), -1)
    place[used] = np.arange(len(used))
    number = place[number]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.full((len(left), len(right)), float(everywhere.sum()), np.float32)
    step = max(1, MATRIX_CELLS // len(sizes))
    for at in range(0, len(used), step):
        a, b = np.searchsorted(number, (at, at + step))
        part = np.zeros((len(sizes), min(step, len(used) - at)), np.float32)
        part[row[a:b], number[a:b] - at] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    shared = _overlaps(left, right)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return shared * (1 + threshold) >= threshold * total - 1e-6 * total


def _lowest(links: np.ndarray) -> np.ndarray:
    """Number of the first row that each row of a symmetric link matrix is connected with."""
    label = np.arange(len(links))
    while True:
        spread = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        spread = spread[spread]
        if (spread == label).all():
            return label
        label = spread


def _verify(rows: list[tuple[int, int, int, np.ndarray]], one_block: bool, threshold: float):
    """For the rows (side, node, copies, set) of a pair of blocks: (node, documents, texts, edge) of each."""
    sides = [[r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]]
    if one_block:
        sets = [r[3] for r in sides[0]]
        links = _linked(sets, sets, threshold)
        np.fill_diagonal(links, True)
        nodes = np.array([r[1] for r in sides[0]], np.int64)
        root = _lowest(links)
        np.fill_diagonal(links, False)
        copies = np.array([r[2] for r in sides[0]], np.float64)
        yield nodes, links @ copies, links.sum(axis=1), nodes[root]
    elif sides[0] and sides[1]:
        a, b = sides
        links = _linked([r[3] for r in a], [r[3] for r in b], threshold)
        nodes = np.array([r[1] for r in (*a, *b)], np.int64)
        square = np.eye(len(nodes), dtype=bool)
        square[:len(a), len(a):] = links
        square[len(a):, :len(a)] = links.T
        root = _lowest(square)
        copies = np.array([r[2] for r in (*a, *b)], np.float64)
        square[np.arange(len(nodes)), np.arange(len(nodes))] = False
        yield nodes, square @ copies, square.sum(axis=1), nodes[root]


def _verified(groups: DataFrame, threshold: float) -> DataFrame:
    """(node, documents, texts, edge) from rows of (task, one_block, side, node, copies, hashes), dealt and sorted by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, task, one = [], None, False

        def flush(found):
            parts = [np.concatenate(x) for x in zip(*found)]
            return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.int64)),
                                               pa.array(parts[3], pa.int64())], names=["node", "documents", "texts", "edge"])

        for batch in batches:
            found = []
            tasks, ones, side, node, copies = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                if tasks[i] != task and rows:
                    found += _verify(rows, one, threshold)
                    rows = []
                task, one = tasks[i], ones[i]
                rows.append((side[i], node[i], copies[i], values[ends[i]:ends[i + 1]]))
            if found:
                yield flush(found)
        if rows and (found := list(_verify(rows, one, threshold))):
            yield flush(found)

    return small_batches(groups).mapInArrow(run, "node bigint, documents bigint, texts bigint, edge bigint")


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (task, one_block, side, node): every member with each pair of blocks that it takes part in.

    Size classes are powers of 1 / threshold, so linked sets lie in one class or in neighbouring ones.
    """
    width = math.log(1 / threshold)
    members = members.withColumn("size_class", F.floor(F.log(F.greatest("shingles", F.lit(1))) / width + 1e-9).cast("int"))
    counts = written(members.groupBy("component", "size_class").agg(F.count("*").alias("n"), F.sum("shingles").alias("s")).select(
        "component", "size_class", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    # The blocks of the next lower and next higher class, 0 where there is none.
    near = counts
    for name, step in (("below", -1), ("above", 1)):
        other = counts.select("component", (F.col("size_class") - step).alias("size_class"), F.col("blocks").alias(name))
        near = near.join(other, ["component", "size_class"], "left")
    near = written(near.na.fill(0, ["below", "above"]), "near-blocks")
    dealt = written(members, "members").join(near, ["component", "size_class"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    own, zero = F.col("block"), F.lit(0)

    def numbers(n):
        return F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(numbers(F.col("blocks")), lambda j: F.struct(
        F.col("size_class").alias("c"), zero.alias("up"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side")))
    above = F.transform(numbers(F.col("above")), lambda j: F.struct(
        F.col("size_class").alias("c"), F.lit(1).alias("up"), own.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    below = F.transform(numbers(F.col("below")), lambda j: F.struct(
        (F.col("size_class") - 1).alias("c"), F.lit(1).alias("up"), j.alias("i"), own.alias("j"), F.lit(1).alias("side")))
    each = dealt.select("node", "copies", "component", F.explode(F.concat(same, above, below)).alias("p"))
    return each.select(F.concat_ws("/", "component", "p.c", "p.up", "p.i", "p.j").alias("task"),
                       ((F.col("p.up") == 0) & (F.col("p.i") == F.col("p.j"))).alias("one_block"), F.col("p.side").alias("side"), "node", "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
                    recall: float = 0.9997) -> DataFrame:
    """A row for each document: id, text_hash, class_id, class_key, n_links (documents), n_text_links (different texts).

    ``class_id`` is the smallest id of the class, which classes may share where ids are null or repeat;
    ``class_key``, the smallest node of the class, is its own.
    """
    spark = docs.sparkSession
    sketched = written(sketches(docs, band_shape(threshold, recall), words, id_col, text_col), "sketches")
    nodes = written(sketched.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"),
                                                 F.first("bands").alias("bands")), "nodes")
    keyed = nodes.where("shingles > 0").select("node", F.explode("bands").alias("band"))
    buckets = written(keyed.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "centre"), "buckets")
    ties = keyed.join(buckets, "band").where("node != centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    clusters = written(components(ties), "clusters")

    members = clusters.join(nodes.select("node", "first_id", "copies", "shingles"), "node")
    members = written(members.select("component", "node", "first_id", "copies", "shingles"), "cluster-members")
    wanted = members.select("first_id").distinct()
    # Texts that no cluster needs leave before any shuffle; of the others a few too many are hashed, and leave as sets.
    texts = sieve.split(docs.select(col(id_col).alias("first_id"), col(text_col).alias("t")), "first_id", wanted)[1].select("t")
    sets = _shingle_sets(texts, words).join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "shingle-sets")
    pairs = written(_blocks(members.select("component", "node", "copies", "shingles"), threshold), "block-pairs")
    groups = pairs.join(sets, "node").select("task", "one_block", "side", "node", "copies", "hashes")
    groups = groups.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("task")
    verified = written(_verified(groups, threshold), "verified")

    links = verified.groupBy("node").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    classes = components(verified.where("edge != node").select(F.col("node").alias("u"), F.col("edge").alias("v")))
    classes = written(classes, "classes")
    ids = classes.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = classes.join(written(ids, "class-ids"), "component").select("node", "class_id", F.col("component").alias("class_key"))
    about = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(named, "node", "left")
    # A class of null ids only has no name, but it has a key.
    about = written(about.select("node", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_key", "node").alias("class_key"),
                                 (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                 F.coalesce("texts", F.lit(0)).alias("n_text_links")), "about")
    return sketched.select("id", "text_hash", "node").join(about, "node").select(
        "id", "text_hash", "class_id", "class_key", "n_links", "n_text_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without all of each class but the one with the smallest id, with the columns they came with.

    Which rows go is decided on ids and hashes; the others pass a bitmap as they are read (see ``sieve``).
    """
    found = near_duplicates(docs, id_col, text_col, **settings).groupBy("id", "text_hash", "class_id", "class_key").agg(F.count("*").alias("alike"))
    found = written(found.withColumn("key", sieve.text_key(F.col("id"), F.col("text_hash"))), "near-duplicates")
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, sieve.text_key(col(id_col), F.xxhash64(F.coalesce(col(text_col), F.lit("")))).alias("key"))
    keeps = F.col("id").eqNullSafe(F.col("class_id"))
    # An id with several texts of one class stays with one of them, and so does a row that repeats.
    first = found.where(keeps).groupBy("class_key").agg(F.min_by("key", "text_hash").alias("key"), F.sum("alike").alias("alike"))
    repeated = written(first.where("alike > 1"), "repeated")
    doubled = found.where(keeps).join(repeated.select("class_key"), "class_key", "left_semi")
    gone = written(found.where(~keeps).select("key").unionByName(doubled.select("key")), "gone")
    kept = sieve.anti(keyed, "key", gone, found)
    one = sieve.semi(keyed, "key", repeated).groupBy("key").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(one.select("row")).select("row.*")
