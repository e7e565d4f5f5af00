"""Stages of the corpus pipeline; each takes documents, all but the last return documents.

1. language ID: a model is learned from the labelled rows, texts that it rejects go;
2. exact dedup: of equal texts the one with the smallest id stays;
3. n-gram Jaccard join: of near duplicates (word 5-grams, 0.8 or more) the smallest id stays;
4. mixing: documents are sampled so that sources, languages and topics have their target weights;
5. packing: what is left is packed into windows, a row for each piece of a document.

Each stage is defined for nulls, empty and very long texts, ties, repeated rows, empty tables and
further columns as its operator is; columns that it does not need are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwater.llm import exact_dedup, language_id, mixing, ngram_join, packing
from rillwater.llm.tables import col, table, written
from rillwater.plans import keep

REMEMBERED = 60_000  # words of a packing task, whose worker has run the other stages too

ORACLE_SQL: str | None = None  # the language model and MinHash cannot be stated in SQL; see tests/llm


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    return language_id.predict(docs, model, [row]).where("not rejected").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("kept").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), col("doc_id"), remembered=REMEMBERED)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = keep.stored()
        out = stage(spark, docs, sf_dir)
        after = keep.stored()
        docs = written(out, name.replace(" ", "-"))
        keep.remove_stored(before, after)  # the stage's own tables, now that its result is stored
    return STAGES[-1][1](spark, docs, sf_dir)
