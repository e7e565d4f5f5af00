import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from rillwater.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c) for key, c in counted if c]
    n_docs, all_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counted:
            spread = 100 - 50 + (50 * sum(c.values()) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * spread))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **settings):
    table = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, word string, score int")
    asked = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, id int")
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in ranked_search.rank(table, asked, **settings).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "ñandú", "x2", "Zoë"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=rng.choice([3, 8, 40, 200])))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " .,; \n"), (7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (None, docs[9][1]), (-5, docs[9][1]),
             (403, "w3 " * 50_000), (404, " ".join(f"only{i}" for i in range(5000))), (405, "W1 w1_w2\x00w1ñW2")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20])))) for i in range(25)]
    items += [(90, None), (91, "?!"), (92, "nowhere"), (93, "w0"), (5, "w5 w9"), (5, "w5 w9"), (None, "W1 only77 zoë"), (94, " ".join(f"only{i}" for i in range(4000)))]
    return docs, items


def test_equals_brute_force(spark, corpus):
    assert ranked(spark, *corpus) == brute(*corpus)
    assert ranked(spark, *corpus, top=3) == brute(*corpus, top=3)


def test_blocks_and_groups_change_nothing(spark, corpus, monkeypatch):
    for name, value in (("BLOCK_DOCS", 17), ("BLOCK_CHARS", 9000), ("ITEM_TERMS", 60), ("ITEMS_AT_ONCE", 3), ("RANGES_AT_ONCE", 2)):
        monkeypatch.setattr(ranked_search, name, value)
    assert ranked(spark, *corpus, top=5) == brute(*corpus, top=5)


def test_equal_scores_go_by_id(spark):
    docs = [(k, "same words here") for k in (9, 3, None, 5, 4, 8, 1)] + [(k, f"other text {k}") for k in range(20, 40)]
    assert ranked(spark, docs, [(1, "same here")], top=4) == brute(docs, [(1, "same here")], top=4)


def test_empty_tables(spark, corpus):
    assert ranked(spark, [], corpus[1]) == [] and ranked(spark, corpus[0], []) == [] and ranked(spark, [(1, None)], corpus[1]) == []


def test_the_index_is_handed_over_compressed_and_kept_without_extremes(spark):
    """Each copy of a block in the JVM is its compressed arrays; least and greatest values would be whole rows that the writer holds for each block."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in range(400)], k=60))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    counts = ranked_search.corpus_counts(table)
    stored = ranked_search._stored(ranked_search.build_index(table, counts))
    [row] = stored.collect()
    hashes, sizes = ranked_search.terms_of([t for _, t in docs])
    arrays = ranked_search.build_block(hashes, sizes, *counts)
    raw = sum(len(arrays[k].astype(kind).tobytes()) for k, kind in ranked_search.ARRAYS.items())
    assert sum(len(row[k]) for k in ranked_search.ARRAYS) < raw / 2
    for file in stored.inputFiles():
        groups = pq.ParquetFile(file.removeprefix("file://")).metadata
        for g in range(groups.num_row_groups):
            for c in range(groups.num_columns):
                found = groups.row_group(g).column(c).statistics
                assert found is None or not found.has_min_max


def test_a_tree_holds_every_cell_and_every_maximum():
    draw = np.random.default_rng(4)
    for n in (1, 2, 30, 400):
        rows, columns = draw.integers(0, 300, n), draw.integers(0, 40, n)
        place = np.unique((ranked_search._spread(rows) << 1) | ranked_search._spread(columns))
        value = draw.integers(1, 1000, len(place))
        tree = ranked_search.build_tree(place, value)
        assert len(tree["place"]) <= 2 * len(place) - 1  # compressed: every inner cell has two filled quarters at least
        leaves = tree["level"] == 0
        assert sorted(zip(tree["place"][leaves], tree["most"][leaves])) == sorted(zip(place, value))
        for cell in range(len(tree["place"])):
            side = 2 * int(tree["level"][cell])
            inside = place >> side == tree["place"][cell] >> side
            assert tree["most"][cell] == value[inside].max()


def test_few_cells_are_opened(monkeypatch):
    """Ranges whose bound is too low stay closed: a rare term's documents are found without opening the rest."""
    texts = [" ".join(["common"] * (1 + i % 5)) + f" own{i}" + (" rare" if i == 900 else "") for i in range(2000)]
    hashes, counts = ranked_search.terms_of(texts)
    block = ranked_search.Block(ranked_search.build_block(hashes, counts, 2000, len(hashes)), 2000)
    opened = []
    down = block.down
    monkeypatch.setattr(ranked_search, "RANGES_AT_ONCE", 1)
    block.down = lambda cell, *rest: (opened.append(len(cell)), down(cell, *rest))[1]
    words = np.sort(ranked_search.terms_of(["common rare"])[0])
    weights = np.where(words == ranked_search.terms_of(["rare"])[0][0], 7000, 10)
    item, column, score = block.search(np.zeros(2, np.int64), words, weights, 1, 1, np.zeros(1, np.int64))
    assert column.tolist() == [900] and sum(opened) < 1000
