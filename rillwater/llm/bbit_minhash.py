"""Near duplicates by b-bit MinHash.

1. A document becomes the set of its word 4-gram hashes; equal sets are one node. Of a few hundred
   minima, runs of some (bands) are hashed for candidate generation, and of each minimum only the
   lowest ``BITS`` bits are kept, packed into a signature of about 100 bytes.
2. Nodes meet on their bands' hashes. Each is paired with the smallest node of its buckets, its centre.
   A pair's similarity is estimated by counting equal fields of the signatures; as unequal minima
   agree in b bits by chance, one time in 2^b, the share is corrected for that. Pairs whose estimate is
   below the threshold by more than ``SIGMAS`` standard errors go; all of this is Spark's own bit arithmetic.
3. What is left is confirmed on full sets: the nodes of a centre are dealt into groups of about
   ``GROUP_NODES``, and all pairs of a group are compared. Components of the links are first classes.
4. Buckets of which all nodes are in one class are finished. In the others only pairs of different classes
   are open: the nodes outside a bucket's largest class meet each other, and those of all buckets with the same
   largest class meet that class once, in blocks of which signatures are compared by matrix; nodes with an
   open candidate are confirmed on full sets. So each two nodes that share a bucket have been compared or are in one
   class already, and no list of a group's pairs is ever made.
5. Components of all links name the classes.

Words are runs of anything but ASCII white space, with only A-Z lowered. A text of one to three words has one
shingle. Two texts are linked if 100 times the shared shingles are at least 80 times all of both.

Defined results: a null text counts as empty; texts without words have no shingle, are linked with nothing and
are classes of their own. Rows that repeat are linked like others. A class is named by its smallest id (null ids
are larger than all others); a class of null ids only has a null name. ``kept`` marks rows whose id is that name,
so rows with one id stay or go together. An empty table gives no rows. Other columns take no part. Sets and shingles
are told apart by 64-bit hashes. Of pairs at exactly the threshold a share of ``1 - recall`` shares no band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm import sieve
from rillwater.llm.components import components
from rillwater.llm.ngram_join import _groups, _lowest, _node_of, _overlaps, band_shape
from rillwater.llm.shingles import _mix, distinct, word_hashes, word_runs
from rillwater.llm.tables import col, shuffle_partitions, small_batches, written

BITS = 2
SIGMAS = 6.0
GROUP_NODES = 64  # of a centre that are confirmed together
BLOCK_NODES = 512  # whose signatures are compared with another block's

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[32, *range(9, 14)]] = False
EVEN_BITS = 0x5555555555555555


def shingles_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    return word_runs(*word_hashes(texts, WORD_BYTES), words)


def packed(minima: np.ndarray) -> np.ndarray:
    """The lowest bits of minima (rows x hashes) in 64-bit words (rows x words)."""
    fields = 64 // BITS
    rows, k = minima.shape
    low = np.zeros((rows, -(-k // fields) * fields), np.uint64)
    low[:, :k] = minima & np.uint32((1 << BITS) - 1)
    shifts = np.arange(fields, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(rows, -1, fields) << shifts, axis=2)


def sketches(docs: DataFrame, shape: tuple[int, int], words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, shingles, bands, signature) of every document."""
    bands, rows = shape
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("t"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, node bigint, shingles bigint, bands array<bigint>, signature array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(12)
        factors = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        turns = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        weights = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

        def lists(table: np.ndarray) -> pa.Array:
            ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
            return pa.ListArray.from_arrays(ends, pa.array(table.view(np.int64).ravel()))

        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                hashes, counts = shingles_of(group, words)
                sets = list(distinct(hashes, counts))
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                minima = np.zeros((len(counts), bands * rows), np.uint32)
                for k in range(bands * rows if len(full) else 0):
                    minima[full, k] = np.minimum.reduceat((low ^ turns[k]) * factors[k], starts)
                banded = ((minima.astype(np.uint64) + np.uint64(1)) * weights).reshape(len(counts), bands, rows).sum(axis=2, dtype=np.uint64)
                ids = batch.column(0).slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([ids, pa.array([_node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                                  lists(_mix(banded + weights[:bands])), lists(packed(minima))],
                                                 names=["id", "node", "shingles", "bands", "signature"])

    return small_batches(given).mapInArrow(run, schema)


def least_matches(threshold: float, hashes: int) -> int:
    """Equal fields that a pair at the threshold has, less ``SIGMAS`` standard errors."""
    share = threshold + (1 - threshold) / 2 ** BITS
    return int(hashes * share - SIGMAS * (hashes * share * (1 - share)) ** 0.5)


def estimate(matches, hashes: int):
    """Similarity from the number of equal fields, corrected for fields that agree by chance."""
    chance = 1 / 2 ** BITS
    return (matches / hashes - chance) / (1 - chance)


def mismatches(a: Column, b: Column) -> Column:
    """Number of unequal fields of two signatures."""
    def unequal(x: Column) -> Column:
        return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(EVEN_BITS)))

    return F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _mismatch_matrix(signatures: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signatures), len(signatures)), np.int32)
    for word in signatures.T:
        apart = word[:, None] ^ word[None, :]
        out += np.bitwise_count((apart | (apart >> np.uint64(1))) & np.uint64(EVEN_BITS))
    return out


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) from (t); hashes are sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch.column(0)):
                sets = list(distinct(*shingles_of(group, words)))
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_node_of(s) for s in sets], pa.int64()), lists], names=["node", "hashes"])

    return small_batches(docs).mapInArrow(run, "node bigint, hashes array<bigint>")


def _by_task(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of the nodes, marks and lists of each task, from rows of (task, node, mark, list); one task at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            tasks, nodes, marks = (batch.column(i).to_pylist() for i in range(3))
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for i in range(batch.num_rows):
                if tasks[i] != task and held:
                    yield from function(task, held)
                    held = []
                task = tasks[i]
                held.append((nodes[i], marks[i], values[ends[i]:ends[i + 1]].view(np.uint64)))
        if held:
            yield from function(task, held)

    dealt = rows.select("task", "node", "mark", "list").repartition(shuffle_partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return small_batches(dealt).mapInArrow(run, schema)


def confirmed(tasks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that connect what is linked among the nodes of each task, from (task, node)."""
    share = round(100 * threshold)

    def links(task, held):
        found = [h[2] for h in held]
        nodes = np.array([h[0] for h in held], np.int64)
        shared = _overlaps(found, found).astype(np.float64)
        size = np.array([len(s) for s in found], np.float64)
        root = _lowest(100 * shared >= share * (size[:, None] + size[None, :] - shared))
        away = np.flatnonzero(root != np.arange(len(root)))
        if len(away):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], names=["u", "v"])

    rows = tasks.join(sets, "node").select("task", "node", F.lit(0).cast("bigint").alias("mark"), F.col("hashes").alias("list"))
    return _by_task(rows, links, "u bigint, v bigint")


def _open_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (task, node, mark, list) of blocks whose nodes of different classes are still to be compared, from (band, node, label).

    A class that is the largest in many buckets meets the others of all of them once, not once a bucket.
    """
    groups = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    about = groups.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("main_nodes"), F.sum("n").alias("all_nodes"))
    # Buckets of two nodes were compared as node and centre.
    about = written(about.where("main_nodes < all_nodes and all_nodes > 2").select("band", "main"), "open-buckets")
    opened = written(members.join(about, "band"), "open-members")
    zero, own, is_main = F.lit(0), F.col("block"), F.col("label") == F.col("main")

    def numbers(n: str) -> Column:
        return F.sequence(zero, F.col(n) - 1)

    def block(*salts) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(31)), *salts).cast("int")

    sides = written(opened.select("main", "node", "label").distinct(), "sides")
    size = sides.groupBy("main").agg(F.ceil(F.count_if(is_main) / BLOCK_NODES).cast("int").alias("mains"),
                                     F.ceil(F.count_if(~is_main) / BLOCK_NODES).cast("int").alias("rests"))
    dealt = sides.join(written(size, "side-sizes"), "main").withColumn("block", block(F.when(is_main, F.col("mains")).otherwise(F.col("rests"))))
    pairs = F.when(is_main, F.transform(numbers("rests"), lambda r: F.struct(own.alias("i"), r.alias("j")))).otherwise(
        F.transform(numbers("mains"), lambda m: F.struct(m.alias("i"), own.alias("j"))))
    across = dealt.select("node", "label", "main", F.explode(pairs).alias("p")).select(
        F.concat_ws("/", F.lit("m"), "main", "p.i", "p.j").alias("task"), "node", F.col("label").alias("mark"))

    rest = opened.where(~is_main).select("band", "node", "label")
    size = rest.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("rests"), F.min("label").alias("low"), F.max("label").alias("high"))
    size = written(size.where("low != high").select("band", "rests"), "rest-sizes")
    dealt = rest.join(size, "band").withColumn("block", block(F.col("rests")))
    pairs = F.transform(numbers("rests"), lambda r: F.struct(F.least(own, r).alias("i"), F.greatest(own, r).alias("j")))
    among = dealt.select("node", "label", "band", F.explode(pairs).alias("p")).select(
        F.concat_ws("/", F.lit("r"), "band", "p.i", "p.j").alias("task"), "node", F.col("label").alias("mark"))
    return across.unionByName(among).join(nodes.select("node", F.col("signature").alias("list")), "node")


def _open_nodes(blocks: DataFrame, most: int) -> DataFrame:
    """(task, node): the nodes of each block that may be linked with one of another class."""
    def search(task, held):
        labels = np.array([h[1] for h in held])
        apart = _mismatch_matrix(np.stack([h[2] for h in held]))
        some = np.flatnonzero(((apart <= most) & (labels[:, None] != labels[None, :])).any(axis=1))
        if len(some):
            nodes = np.array([h[0] for h in held], np.int64)[some]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(some)), pa.array(nodes)], names=["task", "node"])

    return _by_task(blocks, search, "task string, node bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """A row for each document: id, n_shingles, component_id, kept."""
    shape = band_shape(threshold, recall)
    hashes = shape[0] * shape[1]
    most = hashes - least_matches(threshold, hashes)
    sketched = written(sketches(docs, shape, words, id_col, text_col), "sketches")
    nodes = written(sketched.where("shingles > 0").groupBy("node").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = written(keyed.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "centre"), "buckets")
    # Rows that share no band with any other leave before the shuffle.
    members = written(sieve.split(keyed, "band", buckets)[1].join(buckets, "band"), "members")

    pairs = written(members.where("node != centre").select("node", "centre").distinct(), "pairs")
    signed = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first_id", "signature")
    signed = written(signed, "bucket-nodes")
    near = pairs.join(signed.select("node", F.col("signature").alias("own")), "node").join(
        signed.select(F.col("node").alias("centre"), F.col("signature").alias("other")), "centre")
    near = written(near.where(mismatches(F.col("own"), F.col("other")) <= most).select("node", "centre"), "near-pairs")

    texts = docs.select(col(id_col).alias("first_id"), col(text_col).alias("t"))
    wanted = signed.select("first_id").distinct()
    texts = sieve.split(texts, "first_id", wanted)[1]
    sets = shingle_sets(texts.select("t"), words).join(signed.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "shingle-sets")

    groups = written(near.groupBy("centre").agg(F.ceil(F.count("*") / GROUP_NODES).cast("int").alias("groups")), "groups")
    stars = near.join(groups, "centre").select(
        F.concat_ws("/", "centre", F.pmod(F.xxhash64("node", F.lit(29)), F.col("groups"))).alias("task"), "node")
    centres = groups.select(F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("centre").alias("node")).select(
        F.concat_ws("/", "node", "g").alias("task"), "node")
    links = written(confirmed(stars.unionByName(centres), sets, threshold), "links")

    first = written(components(links), "first-classes")
    labelled = members.select("band", "node").join(first.withColumnRenamed("component", "label"), "node", "left")
    labelled = written(labelled.select("band", "node", F.coalesce("label", "node").alias("label")), "labelled")
    open_nodes = written(_open_nodes(_open_blocks(labelled, signed), most), "open-nodes")
    # Many buckets leave the same nodes open; each such group is confirmed once.
    same = open_nodes.groupBy("task").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(3)), 32)).alias("s"), F.count("*").alias("n"))
    once = same.groupBy("x", "s", "n").agg(F.min("task").alias("task")).select("task")
    more = written(confirmed(open_nodes.join(once, "task", "left_semi"), sets, threshold), "more-links")

    classes = written(components(links.unionByName(more)), "classes")
    known = nodes.select("node", "first_id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = known.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first_id").alias("component_id"))
    about = written(known.join(names, "component").select("node", "component_id"), "names")
    found = sketched.select("id", "node", "shingles").join(about, "node", "left")
    name = F.when(F.col("shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", F.col("shingles").alias("n_shingles"), name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))
