import hashlib
import re

from pyspark.sql import functions as F

from rillwater.llm import exact_dedup

TEXTS = ["a  b", "a b", "a\t\nb", " a b", None, "", "x" * 200_000, "x" * 200_000, "p" * 64 + "one", "p" * 64 + "two", " ", "a b"]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_marks_match_brute_force(make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "a b"), (1, "a b"), (None, "a b"), (None, "only null"), (None, "only null"), (50, "solo")]
    got = sorted((tuple(r) for r in exact_dedup.copies(make_docs(rows)).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute(rows)


def test_drop_copies_keeps_one_whole_row_of_each_text(make_docs):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(1, "a b", "en"), (0, "a  b", "en"), (0, "a  b", "en"), (None, None, None)]
    docs = make_docs(rows).withColumn("id", F.lit(7)).withColumn("row", F.lit("r")).withColumn("text_sha256", F.lit("clash"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(norm(r["text"]) for r in out) == sorted({norm(r[1]) for r in rows})
    assert {r["doc_id"] for r in out if norm(r["text"]) == "a b"} == {0}
    assert all(r["text_sha256"] == "clash" and r["id"] == 7 for r in out)


def test_empty_table(make_docs):
    assert exact_dedup.copies(make_docs([])).count() == 0
    assert exact_dedup.drop_copies(make_docs([])).count() == 0
