"""One check query for each operator, and its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwater.llm import bbit_minhash, chat_trees, exact_dedup, fingerprints, language_id, main_text, mixing, ngram_join, packing, personal_data, ranked_search, toxicity, vector_codes
from rillwater.llm.pipeline import vocabulary
from rillwater.llm.tables import table

HELD_OUT = 2  # remainder of the rows that no label is learned from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS nth FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4 (a null id as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), F.col("doc_id"))


@query("op4_chat_trees", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(13 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), '|', '&pipe;'))
                 + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'))) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""")
def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are reply trees of one branch: each turn replies to the one before."""
    odd = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    given = given.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], given.schema))
    turns = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    replies = given.withColumn("node", F.row_number().over(turns)).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    made = chat_trees.conversations(replies, "conv_id", "node", "parent")
    read = made.select(F.col("tree").alias("conv_id"), "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                       chat_trees.learned_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_text_links")


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    base = F.filter("found", lambda s: s["kind"].isin(*personal_data.BASE_KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "source_group", "lang_group", "topic", "tokens", "probability", "kept")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold() != HELD_OUT))
    held = (fold() == HELD_OUT).alias("held_out")
    return language_id.predict(docs, model, [F.col("doc_id"), held])


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").where(fold() != HELD_OUT), labels)
    scored = toxicity.score(docs, model, [F.col("doc_id"), (fold() == HELD_OUT).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_text(table(spark, sf_dir, "pages"), [F.col("page_id"), F.col("url")])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, every part compared with every entry."""
    def near(n: int) -> str:
        return f"""n{n} AS MATERIALIZED (SELECT nth, part, min({{'apart': list_sum(list_transform(list_zip(piece, middle), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
                                     'entry': entry}}) AS best FROM pieces JOIN b{n} USING (part) GROUP BY nth, part)"""

    def move(n: int) -> str:
        return f"""s{n} AS (SELECT part, entry, place, sum(x)::HUGEINT AS total, count(*) AS number
               FROM (SELECT part, best.entry AS entry, unnest(piece) AS x, generate_subscripts(piece, 1) AS place FROM n{n} JOIN pieces USING (nth, part))
               GROUP BY part, entry, place),
        t{n} AS (SELECT part, entry, list((total - (total % number + number) % number) // number ORDER BY place) AS middle FROM s{n} GROUP BY part, entry),
        b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(t{n}.middle, b{n}.middle)::BIGINT[] AS middle FROM b{n} LEFT JOIN t{n} USING (part, entry))"""

    steps = ", ".join(f"{near(n)}, {move(n)}" for n in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS nth, vec_id, label,
                     list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT nth, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS piece
           FROM kept, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, nth AS entry, piece AS middle FROM pieces WHERE nth < {entries}),
{steps},
{near(rounds)},
codes AS (SELECT nth, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.apart)::BIGINT AS error FROM n{rounds} GROUP BY nth)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(middle, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (nth)"""


@query("op11_vector_codes", _vector_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


@query("op12_bbit_minhash", r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 3, 1)),
                      lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM words),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, s, len(s) AS size, min(doc_id) AS first_id FROM sets WHERE len(s) > 0 GROUP BY s),
held AS MATERIALIZED (SELECT node, size, unnest(s) AS x FROM nodes),
links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM held a JOIN held b ON a.x = b.x AND a.node <> b.node AND 5 * a.size >= 4 * b.size AND 5 * b.size >= 4 * a.size
                       GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.v FROM reached r JOIN links l ON l.u = r.other),
names AS (SELECT r.node, min(o.first_id) AS component_id FROM reached r JOIN nodes o ON o.node = r.other GROUP BY r.node)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) > 0 THEN component_id ELSE doc_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) > 0 THEN component_id ELSE doc_id END AS kept
FROM sets LEFT JOIN (SELECT s, component_id FROM nodes JOIN names USING (node)) named ON named.s = sets.s""")
def op12_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op13_ranked_search", r"""
WITH words AS (SELECT n, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents)),
counted AS MATERIALIZED (SELECT n, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS MATERIALIZED (SELECT n, sum(tf)::BIGINT AS terms FROM counted GROUP BY n),
whole AS (SELECT count(*) AS documents, sum(terms)::BIGINT AS terms FROM sizes),
asked AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
weights AS (SELECT term, floor(1000 * ln((2 * whole.documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole
            WHERE term IN (SELECT term FROM asked) GROUP BY term, whole.documents),
scored AS (SELECT i, item_id, n, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * sizes.terms * whole.documents) // whole.terms))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (n), whole GROUP BY i, item_id, n, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
