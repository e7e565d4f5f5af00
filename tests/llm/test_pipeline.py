import random

import pytest
from pyspark.sql import functions as F
from test_fingerprints import shingle_set

import corpus_pipeline
from rillwater.llm import pipeline
from rillwater.llm.tables import table

NUMBERS = [8, 1, 5, 7, 3]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages_on_the_given_documents(spark, sf_dir):
    """Each stage on what the one before kept, against what the decisions must be by brute force."""
    docs = table(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == len(NUMBERS)
    before, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir)
        if k < 4:
            assert after.columns == docs.columns
        after = after.cache()
        kept.append(after.collect())
        before = after
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    languages, exact, near, mixed, packed = kept
    # In these documents all have letters, and next to none is unlike all four languages.
    assert len(languages) >= 0.98 * len(texts)
    first = {}
    for r in sorted(languages, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(r["text"].replace("\n", " ").split(" ")), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(first.values())
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in exact}
    label = {i: i for i in sets}
    ids, changed = sorted(sets), True
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if jaccard(sets[a], sets[b]) >= 0.8]
    while changed:
        changed = False
        for a, b in close:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["doc_id"] for r in near} == set(label.values())
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and 0.5 * len(near) < len(mixed) < len(near)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    whole = {r["doc_id"]: r["doc_tokens"] for r in packed}
    placed = {}
    for r in packed:
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["length"]
    assert placed == whole
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in run.collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in packed)


@pytest.fixture(scope="module")
def odd(make_docs):
    rng = random.Random(3)
    words = {"en": "the house and garden were near this old river with stone".split(), "de": "das haus und der garten waren nahe dem alten fluss".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choices(words[lang], k=60)), lang, f"s{i % 4}"))
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "?? 12 !!", "de", None), (3, rows[3][1], "en", "s3"), (3, rows[3][1], "en", "s3"),
             (None, rows[5][1] + " null id", "en", "s1"), (203, "garden " * 100_000, "en", "s1"), (204, rows[7][1].replace(" ", "  "), "en", "s2")]
    return make_docs(rows).withColumn("node", F.lit("a")).withColumn("id", F.lit(1)).withColumn("row", F.lit("r")).withColumn("kept", F.lit("k"))


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_clashing_names(spark, odd, sf_dir, k):
    out = pipeline.STAGES[k][1](spark, odd, sf_dir)
    rows = out.collect()
    if k < 4:
        assert out.columns == odd.columns
        assert all(r["kept"] == "k" and r["row"] == "r" for r in rows)
    ids = [r["doc_id"] for r in rows]
    if k == 0:
        assert not {200, 201, 202} & set(ids) and ids.count(3) == 3 and None in ids
    if k in (1, 2):
        assert ids.count(3) == 1 and 204 not in ids and (None in ids) == (k == 1)  # the null id is a near copy only


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, make_docs, sf_dir, k):
    assert pipeline.STAGES[k][1](spark, make_docs([]), sf_dir).count() == 0
