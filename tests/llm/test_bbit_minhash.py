import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwater.llm import bbit_minhash, queries, sieve
from rillwater.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                label[root(i)] = root(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[root(i)] = min(key, names.get(root(i), key))
    return sorted(((key, len(sets[i]), names.get(root(i)), key == names.get(root(i))) for i, (key, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(14)
    words = [f"w{i}" for i in range(2000)]
    rows, key = [], 0
    for size, group, edits in ((200, 150, 9), (60, 12, 3), (12, 4, 1), (400, 3, 20), (100, 90, 5)):
        base = rng.choices(words, k=size)
        for _ in range(group):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((key, " ".join(text)))
            key += 1
    chain = rng.choices(words, k=300)
    for i in range(60):  # neighbours are near, the ends have nothing in common
        rows.append((key, " ".join(chain)))
        key += 1
        chain = chain[12:] + rng.choices(words, k=12)
    rows += [(key + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n\x0b"), (903, "one two"), (904, "One  two"), (905, "two one"), (906, rows[0][1]), (None, rows[1][1]),
             (3, rows[3][1]), (3, rows[3][1]), (907, "lone " * 100_000), (908, "\xc9t\xe9 a b c"), (909, "\xe9t\xe9 a b c"), (910, "a\x00b \x1f c d"),
             (None, "alone with null id"), (911, "z" * 2_500_000 + " a b c d e"), (912, "z" * 2_500_000 + " a b c d e f")]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(make_docs, planted):
    docs = make_docs(planted).withColumn("node", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("__row", F.lit(1))
    want = [(k, n, c, k == c if k is not None else c is None) for k, n, c, _ in brute(planted)]
    assert found(bbit_minhash.near_duplicates(docs)) == sorted(want, key=repr)


def test_small_groups_and_blocks_change_nothing(make_docs, planted, monkeypatch):
    monkeypatch.setattr(bbit_minhash, "GROUP_NODES", 3)
    monkeypatch.setattr(bbit_minhash, "BLOCK_NODES", 4)
    rows = [r for r in planted if r[0] is not None and len(r[1] or "") < 10_000]
    assert found(bbit_minhash.near_duplicates(make_docs(rows))) == brute(rows)


def test_all_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_bbit_minhash"](spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(make_docs):
    assert bbit_minhash.near_duplicates(make_docs([])).count() == 0


def test_estimates_are_corrected_for_chance(spark):
    draw = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.9):
        a = draw.integers(0, 1 << 32, (200, 400), dtype=np.uint64).astype(np.uint32)
        b = np.where(draw.random((200, 400)) < share, a, draw.integers(0, 1 << 32, (200, 400), dtype=np.uint64).astype(np.uint32))
        x, y = bbit_minhash.packed(a), bbit_minhash.packed(b)
        apart = [bbit_minhash._mismatch_matrix(np.stack([p, q]))[0, 1] for p, q in zip(x, y)]
        assert abs(np.mean([bbit_minhash.estimate(400 - n, 400) for n in apart]) - share) < 0.01
        pairs = spark.createDataFrame([(p.view(np.int64).tolist(), q.view(np.int64).tolist()) for p, q in zip(x, y)], "a array<long>, b array<long>")
        assert [r[0] for r in pairs.select(bbit_minhash.mismatches(F.col("a"), F.col("b"))).collect()] == apart


def test_a_sieve_loses_no_key(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("nullif(id, 17) AS k", "id AS v")
    for most in (8192, 1):
        monkeypatch.setattr(sieve, "MOST_ROWS", most)
        keys = spark.range(0, 5000, 50).selectExpr("nullif(id, 100) AS k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
        without, maybe = sieve.split(rows, "k", keys)
        got = {r["v"] for r in maybe.collect()}
        assert {v for v in range(0, 5000, 50) if v != 100} | {17} <= got and len(got) < 400
        assert without.count() + len(got) == 5000 and without.columns == rows.columns
