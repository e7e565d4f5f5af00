import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwater.llm import components, ngram_join, queries, shingles
from rillwater.llm.tables import table


def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """(id, class, links, text links) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    near = [[a == b or len(a & b) >= threshold * len(a | b) for b in sets] for a in sets]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(label[j] for j in range(len(rows)) if near[i][j])
            if low < label[i]:
                label[i], changed = low, True
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i]]
        name = min((x for x in ids if x is not None), default=None)
        out.append((key, name, sum(near[i]) - 1, len({sets[j] for j in range(len(rows)) if near[i][j]}) - 1))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for size, group in ((200, 40), (60, 6), (12, 3), (400, 2)):
        base = rng.choices(words, k=size)
        for _ in range(group):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((key, " ".join(text)))
            key += 1
    rows += [(key + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  two"), (505, "two one"), (506, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (507, "lone " * 100_000)]
    rng.shuffle(rows)
    return rows


def test_classes_and_links_equal_brute_force(make_docs, planted):
    docs = make_docs(planted).withColumn("node", F.lit("clash")).withColumn("id", F.lit(0))
    assert found(ngram_join.near_duplicates(docs)) == brute(planted)


def test_blocks_change_nothing(make_docs, planted, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    monkeypatch.setattr(ngram_join, "MATRIX_CELLS", 900)
    assert found(ngram_join.near_duplicates(make_docs(planted))) == brute(planted)


def test_all_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in queries.QUERIES["op5_ngram_join"](spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)


def test_one_document_of_each_class_stays(make_docs, planted):
    docs = make_docs(planted).withColumn("row", F.lit("r")).withColumn("hash2", F.lit(1))
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted({repr(c) for _, c, _, _ in brute(planted)})


def test_unlike_texts_of_one_id_all_stay(make_docs):
    def text(mark):
        return " ".join(f"{mark}{i}" for i in range(40))

    near = text("a").replace("a39", "x")  # of the first null text
    rows = [(None, text("a")), (None, near), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")),
            (7, text("e")), (8, text("e")), (9, text("f")), (None, text("f")), (None, ""), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(make_docs(rows)).collect()]
    want = [(None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (9, text("f"))]
    assert len([k for k in kept if k in ((None, text("a")), (None, near))]) == 1
    assert sorted((k for k in kept if k in want), key=repr) == sorted(want, key=repr)
    assert len([k for k in kept if not k[1]]) == 1 and len(kept) == 7


def test_empty_table(make_docs):
    assert ngram_join.near_duplicates(make_docs([])).count() == 0
    assert ngram_join.drop_near_duplicates(make_docs([])).count() == 0


def test_band_shape_reaches_the_recall():
    for t, r in ((0.8, 0.9997), (0.5, 0.99), (0.9, 0.9999)):
        bands, rows = ngram_join.band_shape(t, r)
        assert bands * rows <= 400 and 1 - (1 - t ** rows) ** bands >= r


def test_shingles_of_cut_texts(monkeypatch):
    text = "Ä b c\td e\x00f  g " * 50 + "z" * 9000
    whole = [s.tolist() for s in shingles.distinct(*shingles.shingle_hashes([text, "", "a b", text]))]
    monkeypatch.setattr(shingles, "GROUP_BYTES", 23 * 500)
    assert [s.tolist() for s in shingles.distinct(*shingles.shingle_hashes([text, "", "a b", text]))] == whole
    assert whole[0] == whole[3] and not whole[1] and len(whole[2]) == 1 and len(whole[0]) == len(shingle_set(text.replace("\x00", " ")))


def test_components(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, 1001), (1001, 1003), (1005, 1005), (-4, 1003), (1003, -4)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: -4 for i in (-4, 1000, 1001, 1003)}}
    assert np.array(components.components(spark.createDataFrame([], "u long, v long")).collect()).size == 0
