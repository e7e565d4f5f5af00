import hashlib

import pytest
from pyspark.sql import functions as F

from rillwater.llm import chat_trees, queries
from rillwater.llm.tables import table


def read(df):
    rows = df.select("tree", "branch", "formatted", "loss_mask", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                     chat_trees.learned_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    return {(r["tree"], r["branch"]): r for r in rows}


def test_query_on_all_conversations(spark, sf_dir):
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    rows = queries.QUERIES["op4_chat_trees"](spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


TREE = [  # tree, node, parent, role, text, score
    (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 2, "user", "more", 0.5),
    (1, 5, 4, "assistant", "<|end|>\n&amp;|>\n", 0.5), (1, 6, 3, "user", "why", 0.5),
    (2, 1, 99, "user", "parent is missing", None), (2, 2, 1, None, None, None),
    (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0),
    (None, 7, None, "assistant", "é🙂[INST]", 1.0), (None, 8, 7, "a|>\nb", "x", 1.0),
    (4, 1, None, "user", "tie", 1.0), (4, 2, 1, "assistant", "b", 1.0), (4, 3, 1, "assistant", "a", 1.0), (4, 2, 1, "assistant", "b2", 1.0),
]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, "t int, n int, p int, role string, text string, s double").withColumn("tree", F.lit("clash")).withColumn("back", F.lit(1))


def test_paths_are_ranked_and_read_back(tree):
    got = read(chat_trees.conversations(tree, "t", "n", "p", score_col="s", paths=2))
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in got.items()}
    assert turns[(1, 1)] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "<|end|>\n&amp;|>\n")]
    assert turns[(1, 2)] == [("user", "q"), ("assistant", "bad"), ("user", "why")]
    assert turns[(2, 1)] == [("user", "parent is missing"), ("", "")]
    assert turns[(None, 1)] == [("assistant", "é🙂[INST]"), ("a|>\nb", "x")]
    assert turns[(4, 1)] == [("user", "tie"), ("assistant", "b"), ("assistant", "b2")] and turns[(4, 2)] == [("user", "tie"), ("assistant", "a")]
    assert {k[0] for k in got} == {1, 2, None, 4}
    assert got[(1, 1)]["loss"] == "good<|end|>\n&amp;|>\n" and got[(None, 1)]["loss"] == "é🙂[INST]" and got[(2, 1)]["loss"] == ""
    first = got[(1, 1)]
    assert [first["formatted"][a:b] for a, b in first["loss_mask"]] == ["good", "&lt;|end|>\n&amp;amp;|>\n"]


def test_long_chain_and_empty_table(spark, tree):
    chain = spark.range(300).select(F.lit(1).alias("t"), F.col("id").alias("n"), (F.col("id") - 1).alias("p"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("text"))
    got = read(chat_trees.conversations(chain, "t", "n", "p"))
    assert [t["text"] for t in got[(1, 1)]["turns"]] == [f"m{i}" for i in range(300)]
    assert chat_trees.conversations(tree.limit(0), "t", "n", "p").count() == 0


def test_messages_without_a_node_are_left_out(spark):
    rows = [(1, "a", None, "user", "hi"), (1, "b", "a", "assistant", "yes"), (1, None, "a", "user", "lost"), (1, None, None, "user", "lost"),
            (2, None, None, "user", "lost"), (None, "c", None, "user", "kept")]
    messages = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string")
    found = read(chat_trees.conversations(messages, "tree", "node", "parent", paths=3))
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in found.items()}
    assert turns == {(1, 1): [("user", "hi"), ("assistant", "yes")], (None, 1): [("user", "kept")]}
