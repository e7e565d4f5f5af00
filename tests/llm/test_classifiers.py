import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwater.llm import language_id, queries, subwords, toxicity
from rillwater.llm.tables import table


def held_out(i):
    return binascii.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_rows(spark, sf_dir):
    rows = queries.QUERIES["op8_language_id"](spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.85


def test_toxicity_of_held_out_rows(spark, sf_dir):
    rows = queries.QUERIES["op9_toxicity"](spark, sf_dir.replace("0.001", "0.1")).collect()
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir.replace("0.001", "0.1"), "labels").collect()}
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = [r["predicted"] for r in tested if truth[r["doc_id"]] == 1]
    false = [r["predicted"] for r in tested if truth[r["doc_id"]] == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.03


def test_odd_rows_and_clashing_names(make_docs):
    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    rows = [(i, (words["en"] if i % 2 else words["de"]) + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 34 ½ !", None), (None, "the house", None), (103, "the garden " * 200_000, None), (1, rows[1][1], "en")]
    docs = make_docs(rows + odd).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    model = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.predict(docs, model, [F.col("doc_id")]).collect()}
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and out[100]["rejected"] and out[100]["score"] == 0
    assert out[None]["lang_pred"] == "en" and out[103]["lang_pred"] == "en" and out[0]["lang_pred"] == "de"


def test_rare_labels_are_in_the_sample(make_docs, monkeypatch):
    rows = [(i, f"the house {i}" if i % 2 else f"das haus {i}", "en" if i % 2 else "de") for i in range(8000)]
    docs = make_docs(rows + [(10_000 + i, f"la casa {i}", "es") for i in range(16)])
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda texts, labels, s: seen.extend(labels))
    language_id.train(docs, settings=language_id.Settings(train_rows=200))
    assert seen.count("es") == 16 and seen.count("en") > 60 and seen.count("de") > 60 and len(seen) <= 400


def test_without_labels_and_without_rows(make_docs):
    docs = make_docs([(1, "some text"), (2, None)])
    model = language_id.train(docs)
    assert {r["lang_pred"] for r in language_id.predict(docs, model, [F.col("doc_id")]).collect()} == {"und"}
    one = language_id.train(make_docs([(1, "some text", "en")]))
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs, one, [F.col("doc_id")]).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]
    assert language_id.predict(make_docs([]), model, [F.col("doc_id")]).count() == 0


@pytest.fixture(scope="module")
def insult_model():
    rng = np.random.default_rng(0)
    clean = ["garden", "window", "paper", "morning", "river", "stone", "music", "kitchen"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 60))
        if i % 5 == 0:
            words[int(rng.integers(60))] = str(rng.choice(["nincompoop", "blockhead"]))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return toxicity.fit(texts, labels, toxicity.Settings(buckets=1 << 14, window=2))


def test_unseen_misspellings_share_ngrams(insult_model, make_docs):
    docs = make_docs([(1, "garden " * 300 + "nincompooop " + "river " * 300), (2, "garden river " * 300), (3, None), (4, ""), (5, "bl0ckhe4d"), (6, "!!")])
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, insult_model, [F.col("doc_id")]).collect()}
    assert out[1] > 0.3 and out[5] > 0.3
    assert out[2] < 0.3 and out[3] < 0.3 and out[3] == out[4] == out[6]


def test_windows_over_cut_pieces_count(insult_model, monkeypatch):
    text = "garden river " * 40 + "blockhead " + "stone " * 40
    whole = toxicity._score(subwords.WordTable(insult_model.weights, insult_model.sizes, toxicity.plain_spelling), insult_model, [text])
    monkeypatch.setattr(subwords.pieces, "__defaults__", (50,))
    cut = toxicity._score(subwords.WordTable(insult_model.weights, insult_model.sizes, toxicity.plain_spelling), insult_model, [text])
    assert np.allclose(whole, cut)


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.train(docs, none), [F.col("doc_id")]).collect()] == pytest.approx([0, 0], abs=1e-6)
    ones = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, toxicity.train(docs, ones), [F.col("doc_id")]).collect())


def test_hashing_is_the_same_for_a_word_anywhere():
    alone, among = subwords.subword_buckets(["river"], (2, 4), 1 << 20), subwords.subword_buckets(["a", "river", "stone"], (2, 4), 1 << 20)
    assert sorted(alone[1]) == sorted(among[1][among[0] == 1])
