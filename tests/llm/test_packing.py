import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillwater.llm import packing, pipeline, queries
from rillwater.llm.tables import table

PATH = pipeline.vocabulary()
PLAIN = Tokenizer.from_file(PATH)
CHUNKED = packing.ChunkTokenizer(PATH)


def whole(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


PIECES = ["the", "Über", "don't", "'s", "''ll", "İI", "Σ", "é", "é", "x́y", " ", "\n", " ", "\x1c", "\x85", "42", "½", "ª", "…", "<|endoftext|>",
          "<|startoftext|>", "<|", "日本", "a1b2", "...", "ß", "×", "÷", "🙂", "​", "́", "supercalifragilistic", "-", "_"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_chunks_give_the_tokenizers_ids(text):
    assert CHUNKED.ids([text, text + " ", ""])[0].tolist() == whole(text)


def check(rows, texts):
    """Every id of every document in exactly one piece, windows gapless and unpadded."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids = whole(text or "") + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= 2048 and at & (at - 1) == 0
    return by_window


def test_query_on_all_documents(spark, sf_dir):
    rows = queries.QUERIES["op3_packing"](spark, sf_dir).collect()
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    windows = check(rows, texts)
    short = sum(w[0]["sequence_length"] < 256 for w in windows.values())
    assert short <= 8  # one partition
    steps = {}
    for w in windows.values():
        steps[w[0]["step_id"]] = steps.get(w[0]["step_id"], 0) + w[0]["sequence_length"]
    assert sum(v < packing.STEP_TOKENS for v in steps.values()) <= 3 and max(steps.values()) <= packing.STEP_TOKENS


def test_odd_rows(make_docs):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (None, "null id"), (5, " \n "), (6, "x" * 30_000)]
    docs = make_docs(texts).withColumn("start", F.lit("clash")).withColumn("_key_", F.lit(0)).withColumn("length", F.lit(1))
    check(packing.pack(docs, PATH, F.col("doc_id")).collect(), texts)
    assert packing.pack(make_docs([]), PATH, F.col("doc_id")).count() == 0
    twice = packing.pack(make_docs([(1, "same text"), (1, "same text")]).coalesce(1), PATH, F.col("doc_id")).collect()
    assert sum(r["length"] for r in twice) == 2 * len(whole("same text")) + 2
    with_ids = packing.pack(make_docs([(1, "some text")]), PATH, F.col("doc_id"), with_ids=True).orderBy("start").collect()
    assert [i for r in with_ids for i in r["ids"]] == whole("some text") + [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40), st.integers(1, 5))
def test_packer_places_everything_once(lengths, batches):
    packer, windows = packing.Packer(), []
    for k, n in enumerate(lengths):
        windows += packer.add(k, n)
        if k % batches == 0:
            windows += packer.windows(False)
    windows += packer.windows(True)
    placed = {k: [] for k in range(len(lengths))}
    for w in windows:
        size = sum(n for _, _, n in w)
        assert size & (size - 1) == 0 and size <= 2048
        for d, s, n in w:
            placed[d].append((s, n))
    for k, n in enumerate(lengths):
        at = 0
        for s, m in sorted(placed[k]):
            assert s == at
            at += m
        assert at == n


def test_tiers_are_checked(make_docs):
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), PATH, F.col("doc_id"), tiers=(2048, 1000))
