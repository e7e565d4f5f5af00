"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of ASCII white space is
replaced by one space. Only documents that share length and prefix with another
one are read in full and hashed; the rest are known to be unique before that.

Defined results: a null text counts as empty. The smallest id of a group stays;
null ids count as larger than all others, and a group of only null ids keeps one
of them. Rows repeated with the same id and text are copies of each other: one
stays. An empty table gives an empty result. Other columns, whatever their
names, are passed through by ``drop_copies`` and ignored by the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm import sieve
from rillwater.llm.tables import col, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id, group_size.

    Three rounds, each over what the one before left. The counts are combined before
    they are shuffled, so a group that holds a large part of the rows is no hot spot;
    where documents meet the keys that are left, those are a stored table, and AQE
    can split the join on a frequent key.
    """
    text = normalised(col(text_col))
    outline = docs.select(F.length(text).cast("long").alias("chars"),
                          F.xxhash64(F.substring(text, 1, prefix)).alias("start_hash"))
    outline = written(outline.groupBy("chars", "start_hash").agg(F.count("*").alias("n")), "outline")
    lengths = outline.groupBy("chars").agg(F.sum("n").alias("same_length")).where("same_length > 1")
    shared = written(outline.where("n > 1").join(lengths, "chars", "left_semi").select("chars", "start_hash"), "shared-starts")

    bodies = docs.select(col(id_col).alias("id"), text.alias("body"))
    bodies = bodies.select("id", "body", F.length("body").cast("long").alias("chars"),
                           F.xxhash64(F.substring("body", 1, prefix)).alias("start_hash"))
    survivors = bodies.join(shared, ["chars", "start_hash"], "left_semi")
    hashed = survivors.select("id", F.sha2("body", 256).alias("text_sha256"))
    groups = hashed.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return written(groups.where("group_size > 1"), "copy-groups")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """A row for each document: id, text_sha256, keep_id, group_size, kept."""
    groups = copy_groups(docs, id_col, text_col, prefix)
    rows = docs.select(col(id_col).alias("id"), full_hash(col(text_col)).alias("text_sha256"))
    # Rows alike in id and text are counted before the shuffle and told apart by a number after it.
    rows = rows.groupBy("id", "text_sha256").agg(F.count("*").cast("int").alias("alike"))
    marked = rows.join(groups, "text_sha256", "left")
    marked = marked.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("alike"))))
    alone = F.col("group_size").isNull()
    return marked.select(
        "id", "text_sha256",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The documents without all copies but one, with the columns they came with.

    Which rows go is decided on ids and hashes. A bitmap of their keys lets the other rows pass as they are
    read; of whole rows only those that share a bit with a key are shuffled (see ``sieve``).
    """
    groups = copy_groups(docs, id_col, text_col, prefix)
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, col(id_col).alias("id"), full_hash(col(text_col)).alias("text_sha256"))
    keyed = keyed.withColumn("key", sieve.text_key(F.col("text_sha256"), F.col("id")))
    keys = written(keyed.select("id", "text_sha256", "key"), "keys-of-rows")
    members = written(sieve.split(keys, "text_sha256", groups)[1].join(groups, "text_sha256"), "copies")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    # Rows alike in id and text would all stay: they go as well, and one of them comes back.
    alike = written(members.where(stays).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "alike")
    gone = written(members.where(~stays).select("key").unionByName(alike), "gone")
    kept = sieve.anti(keyed.select("row", "key"), "key", gone, keys)
    one = sieve.semi(keyed.select("row", "key"), "key", alike).groupBy("key").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(one.select("row")).select("row.*")
