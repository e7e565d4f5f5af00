import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwater.llm import fingerprints, queries
from rillwater.llm.tables import table


def shingle_set(text, n=5):
    w = "".join(c if c > " " else " " for c in text.lower()).split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(id, chars, hash of the edited text, likeness to it, likeness to the next) in order of ids."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, after), max(len(shingle_set(t)), len(shingle_set(edited)))))
    return sorted(out, key=repr)


def compare(rows, want):
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["fingerprint"]) for r in rows), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    errors = []
    for g, w in zip(got, want):
        assert 0 <= g[3] <= 1 and 0 <= g[4] <= 1
        if w[5] <= fingerprints.FLOOR:
            assert g[3] == pytest.approx(w[3])
        errors += [g[3] - w[3], g[4] - w[4]]
    return np.abs(errors)


def test_query_on_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    found = queries.QUERIES["op2_fingerprints"](spark, sf_dir).collect()
    errors = compare(found, brute(rows))
    assert errors.mean() < 0.03 and errors.max() < 0.25
    texts = {r[0]: r[1] for r in rows}
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(make_docs):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words of a tied id here"), (9, None), (8, ""), (None, "null id text of words"),
            (None, "another null id"), (1, "é" * 100_000 + " x"), (0, "w " * 300_000), (-3, "🙂 emoji 🙂🙂 text and more")]
    docs = make_docs(rows).withColumn("block", F.lit("clash")).withColumn("guest", F.lit(1))
    compare(fingerprints.edited_likeness(docs).collect(), brute(rows))
    compare(fingerprints.edited_likeness(make_docs(rows[:1])).collect(), brute(rows[:1]))
    assert fingerprints.edited_likeness(make_docs([])).count() == 0


def test_order_over_many_blocks(make_docs):
    rng = random.Random(1)
    ids = rng.sample(range(-500, 100_000), 300)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 30)))) for i in ids]
    compare(fingerprints.edited_likeness(make_docs(rows)).collect(), brute(rows))


def test_containment_of_unequal_documents_and_merging():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    long = rng.choices(words, k=40_000)
    part = long[10_000:12_000]
    a, b, other, both = fingerprints.sketches_of([" ".join(x) for x in (long, part, rng.choices(words, k=2000), long + part)])
    assert fingerprints.containment(b, a) == 1.0
    assert fingerprints.containment(a, b) == pytest.approx(0.05, abs=0.02)
    assert fingerprints.likeness(other, a) < 0.02
    merged = fingerprints.merge(a, other)
    assert fingerprints.containment(other, merged) == 1.0 and fingerprints.containment(a, merged) == 1.0
    text = fingerprints.to_text(a)
    again = fingerprints.from_text(text)
    assert again[0] == a[0] and (again[1] == a[1]).all() and fingerprints.likeness(again, a) == 1.0
    assert len(a[1]) == pytest.approx(40_000 / 16, rel=0.1)


def test_fingerprint_column(make_docs):
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(make_docs([(1, "a b"), (2, "A  b"), (3, None), (4, "")]), [F.col("doc_id")]).collect()}
    assert out[1] == out[2] != out[3] == out[4]
