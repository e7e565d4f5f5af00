import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwater.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, row int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(id, label, code, error, label error)} and the digest, entry by entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = max(1, -(-max(len(r[1]) for r in kept) // parts)) * parts
    size = width // parts
    cells = []
    for key, vector, label in kept:
        whole = [math.floor(scale * float(np.float32(x))) for x in vector] + [0] * (width - len(vector))
        cells.append((key, label, [whole[p * size:(p + 1) * size] for p in range(parts)], [float(np.float32(x)) for x in vector]))
    cells.sort(key=lambda c: (c[0] is None, c[0] or 0, c[3]))
    books = [[c[2][p] for c in cells[:entries]] for p in range(parts)]

    def near(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cells:
                groups.setdefault(near(c[2][p], books[p])[1], []).append(c[2][p])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, totals = [], {}
    for key, label, pieces, _ in cells:
        found = [near(piece, book) for piece, book in zip(pieces, books)]
        out.append((key, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
        totals[label] = totals.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*o, totals[o[1]]) for o in out), key=repr), digest


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)


def check(spark, rows, **settings):
    got = vector_codes.compress(vectors(spark, rows), **settings).collect()
    want, digest = brute(rows, **settings)
    assert sorted(((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 0, 0.5, 1]) * rng.random() ** 3 for _ in range(21)], rng.choice([0, 0, 0, 1, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * 21, 1), (202, [float("nan")] * 21, 0), (203, [float("inf")] + [0.0] * 20, 0), (204, [], 5),
             (205, [0.25], None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (3, rows[9][1], 7), (None, rows[4][1], None), (None, [0.0] * 24, 7)]
    rng.shuffle(rows)
    return rows


def test_equals_comparing_all_entries(spark, odd):
    check(spark, odd)
    check(spark, odd, parts=3, entries=5, rounds=2, scale=8)


def test_batches_change_nothing(spark, odd, monkeypatch):
    monkeypatch.setattr(vector_codes, "BATCH_CELLS", 50)
    check(spark, odd)


def test_fewer_rows_than_entries_and_equal_rows(spark):
    check(spark, [(2, [0.5] * 16, 1), (1, [0.5] * 16, 1), (3, [-0.5] * 16, 2)])
    check(spark, [])
    check(spark, [(1, None, 1)])


def test_walks_find_the_lowest_nearest_entry_and_skip_most():
    draw = np.random.default_rng(2)
    for high in (2, 4, 1000):
        book, rows = draw.integers(0, high, (16, 3)), draw.integers(0, high, (500, 3))
        apart = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
        for start in (0, 7):
            index, distance, _ = vector_codes.Orchard(book).nearest(rows, start)
            assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    centres = draw.integers(-10_000, 10_000, (64, 8))
    rows = np.repeat(centres, 20, axis=0) + draw.integers(-50, 50, (1280, 8))
    assert vector_codes.Orchard(centres).nearest(rows)[2] < 0.7 * rows.shape[0] * 64


def test_components_that_cannot_be_coded_are_an_error(spark):
    with pytest.raises(Exception, match="cannot be coded"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 8, 1)])).collect()


def test_decoded_vectors_are_near(spark, odd):
    books = vector_codes.train(vectors(spark, odd), parts=7, entries=64, rounds=4)
    coded = vector_codes.encode(vectors(spark, odd).where("vec_id < 100 and vec_id != 3"), books, [F.col("vec_id"), F.col("embedding").alias("given")]).collect()
    apart = [np.mean((np.array(vector_codes.decode(r["code"], books)[:21]) - np.array(r["given"])) ** 2) for r in coded]
    assert np.mean(apart) < 0.5 * np.mean([np.var(r["given"]) for r in coded])
