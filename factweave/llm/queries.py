"""The operators applied to their whole tables, and the SQL they agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bestfit, centroids, chat, decontam, hardneg, licenses, linedup, minhash, packing, pii, pivots, ppm, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words of a text as a list: ASCII lower case, split at space and \t\n\v\f\r.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents on three-word shingles at 0.85."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


ORACLES["op1_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) m USING (doc_id)"""


@query
def op2_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of all documents, learned from nine tenths of them."""
    return ppm.language_scores(table(spark, folder, "documents"), modulus=10)


@query
def op3_linedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the blocks that earlier documents have: what went, and what is left."""
    left = linedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.transform("cuts", lambda c: F.concat_ws(":", c["start"], c["end"]))
    gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["start"])
    return left.select("doc_id", F.size("cuts").cast("long").alias("n_cuts"), gone.alias("cut_chars"), F.array_join(spans, ",").alias("cuts"), F.length("text").cast("long").alias("left_chars"), F.sha2("text", 256).alias("left_sha256"))


@query
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are made of marks, replayed, rendered and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.replay(*chat.turn_events(rows)))


ORACLES["op4_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(</?SYS>>|</?TURN>>|/?INST\]|/?s>)')) AS escapes,
      CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(role) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
       CAST(sum(length(text) + escapes + marks) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@query
def op5_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of one label at cosine 0.98."""
    return pivots.near_vectors(table(spark, folder, "embeddings"), threshold=0.98)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies; the vocabulary is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), limit=4096, end=2)


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every licence notice in the documents, with the words that differ from its template."""
    said = lambda c: F.array_join(c, " ").alias(c)
    found = licenses.license_blocks(table(spark, folder, "documents"))
    return found.select("doc_id", "start", "end", "license", F.round("saved", 6).alias("saved"), "matched", said("missing"), said("extra"))


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data and disclosing terms of all documents."""
    return pii.digests(pii.personal_data(table(spark, folder, "documents")))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out third."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")), threshold=0.7)


@query
def op10_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Every overlap of a document with a benchmark item, under substitutions."""
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("h")


@query
def op11_hardneg(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector's label is the next one."""
    vectors = table(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    told = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hardneg.mine(told, F.col("vec_id") % 50 == 0)


ORACLES["op11_hardneg"] = """
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS ar, a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
p AS (SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST) AS place FROM s WHERE alike QUALIFY place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS rank FROM p JOIN s USING (ar)
      WHERE NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n"""


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors in eight clusters after ten rounds."""
    return centroids.cluster(table(spark, folder, "embeddings"), k=8, rounds=10, seed=3)


def _clusters_sql(k: int, rounds: int, seed: int, scale: int, dims: int) -> str:
    """The rounds one after another: g0 the first centroids, a_i who is nearest to g_i, g_i+1 the floors of the means."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"g0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS g, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY g < {k})",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {apart}, 'g': g}}) AS n FROM v, g{i} GROUP BY r)")
        if i < rounds:
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            sums = f"SELECT a.n.g AS g, u.i, sum(v[u.i])::HUGEINT AS s, count(*) AS n FROM v JOIN a{i} a USING (r), (SELECT unnest(range(1, {dims + 1})) AS i) u GROUP BY ALL"
            steps.append(f"m{i} AS MATERIALIZED (SELECT g, list({floor} ORDER BY i) AS c FROM ({sums}) GROUP BY g)")
            steps.append(f"g{i + 1} AS MATERIALIZED (SELECT g, coalesce(m.c, o.c) AS c FROM g{i} o LEFT JOIN m{i} m USING (g))")
    last = f"SELECT vec_id, a.n.g::INT AS cluster, a.n.d AS distance, (sum(a.n.d) OVER (PARTITION BY a.n.g))::BIGINT AS cluster_inertia, (sum(a.n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256"
    return f"WITH {', '.join(steps)} {last} FROM v JOIN a{rounds} a USING (r) JOIN g{rounds} ON g = a.n.g"


ORACLES["op12_centroids"] = _clusters_sql(k=8, rounds=10, seed=3, scale=1024, dims=64)


@query
def op13_bestfit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into as few sequences of 2,048 tokens as possible."""
    return bestfit.pack(table(spark, folder, "documents"), tokenizer_path(), limit=2048, end=0)
