"""Queries of the model-knowledge and graph operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vocabularies import COUNTRIES, LABEL_STOP_WORDS, LANGUAGES, MONTHS, NUMBERS
from quillon.operators import clustering as C
from quillon.operators import graph as G
from quillon.operators import knowledge as K
from quillon.operators import labelling as L
from quillon.operators import models as R
from quillon.operators import patches as P
from quillon.operators.products import best, totals
from quillon.plans.model import Model, derive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- the derived model, once more in SQL -------------------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
GEO = "|".join(T.GEO_HINTS)

TOKENS_SQL = """
vocab AS (
  SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents) GROUP BY w
), ranked_words AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS token_id FROM vocab
), gates AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS gate FROM embeddings
), tokens AS (
  SELECT token_id, word, CASE WHEN token_id % 3 = 0 THEN upper(substr(word, 1, 1)) || substr(word, 2) ELSE word END AS token, gate AS embedding
  FROM ranked_words JOIN gates ON token_id = vec_id
)"""


def features_sql(stride: int = 7, offset: int = 1, name: str = "features") -> str:
    return f"""
{name}_logits AS (
  SELECT o.vec_id, t.token_id, t.token, round(list_inner_product(d.gate, t.embedding), 9) AS logit
  FROM gates o JOIN gates d ON d.vec_id = (o.vec_id * {stride} + {offset}) % (SELECT count(*) FROM embeddings) CROSS JOIN tokens t
), {name}_best AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS r FROM {name}_logits
), {name}_top AS (SELECT * FROM {name}_best WHERE r <= 5 AND vec_id % 17 <> 0),
{name} AS (
  SELECT g.label AS layer, g.vec_id AS feature, g.gate, b.token_id, b.token, b.logit AS c_score
  FROM gates g LEFT JOIN {name}_top b ON g.vec_id = b.vec_id AND b.r = 1
)"""


def readable_sql(t: str) -> str:
    return f"(length(trim({t})) > 0 AND octet_length(encode(trim({t}))) <= 30 AND 2 * length(regexp_replace(trim({t}), '[^A-Za-z0-9 \\-''.,]', '', 'g')) >= length(trim({t})))"


def content_sql(t: str) -> str:
    letters = f"length(regexp_replace(trim({t}), '[^A-Za-z]', '', 'g'))"
    return (
        f"({readable_sql(t)} AND length(trim({t})) BETWEEN 3 AND 25 AND {letters} >= floor(length(trim({t})) * 2 / 3.0) AND {letters} > 0 "
        f"AND NOT regexp_matches(trim({t}), '[a-z][A-Z]') AND lower(trim({t})) NOT IN ({STOPS}))"
    )


def band_sql(layer: str) -> str:
    return f"CASE WHEN {layer} < 4 THEN 'syntax' WHEN {layer} < 8 THEN 'knowledge' WHEN {layer} < 10 THEN 'output' ELSE 'unknown' END"


def asked_sql(where: str) -> str:
    return f"""
asked AS (SELECT token_id AS id, word AS text FROM tokens WHERE {where}),
ask_q AS (
  SELECT a.id, list_transform(t.embedding, lambda x: x * 80.0) AS q FROM asked a JOIN tokens t ON a.text = t.word
), scored AS (
  SELECT q.id, f.layer, f.feature, f.token, f.c_score, round(list_inner_product(f.gate, q.q), 9) AS score FROM features f CROSS JOIN ask_q q
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY abs(score) DESC, feature) AS rank FROM scored
)"""


MODEL_SQL = "WITH " + TOKENS_SQL + "," + features_sql()
# Searches take every token whose id is divisible by 20 as their queries; all else works on all tokens.
ASK_SQL = MODEL_SQL + "," + asked_sql("token_id % 20 = 0")
EVERY_SQL = MODEL_SQL + "," + asked_sql("true")


def asked(model: Model) -> DataFrame:
    return every(model).where("id % 20 = 0")


def every(model: Model) -> DataFrame:
    return model.tokens.select(F.col("token_id").alias("id"), F.col("word").alias("text"))


def six(df: DataFrame, *names: str) -> DataFrame:
    """Columns to six digits, by the product with a million as SQL engines round: half-way values then agree."""
    return df.withColumns({n: F.when(F.abs(F.col(n)) < 1e290, F.round(F.col(n) * 1e6) / 1e6).otherwise(F.col(n)) for n in names})


@query("v1_gate_knn", ASK_SQL + " SELECT id, layer, feature, rank, round(score, 6) AS score FROM hits WHERE rank <= 10")
def v1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.gate_knn(K.embedded(asked(m), m), m.features, 10).select("id", "layer", "feature", "rank", "score"), "score")


@query("v4_gate_knn_range", ASK_SQL + """, part AS (
  SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY abs(score) DESC, feature) AS r FROM scored WHERE feature >= 100 AND feature < 300)
SELECT id, layer, feature, r AS rank, round(score, 6) AS score FROM part WHERE r <= 5""")
def v4(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.gate_knn(K.embedded(asked(m), m), m.features, 5, 100, 300).select("id", "layer", "feature", "rank", "score"), "score")


@query("v5_gate_knn_union", ASK_SQL + " SELECT DISTINCT layer, feature FROM hits WHERE rank <= 10")
def v5(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return K.gate_knn(K.embedded(asked(m), m), m.features, 10).select("layer", "feature").distinct()


@query("v6_gate_scores", ASK_SQL + " SELECT id, layer, count(*) AS n, round(sum(score), 5) AS total, round(max(score), 6) AS most, round(min(score), 6) AS least FROM scored GROUP BY id, layer")
def v6(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    sums = totals(K.embedded(asked(m), m), m.features.select("layer", "gate"), left_vector="q", right_vector="gate", key=["id"], per="layer")
    return sums.select("id", "layer", "n", F.round("total", 5).alias("total"), F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


@query("v9_sq8", """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
r AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM g),
q AS (SELECT vec_id, v, lo, hi, list_transform(v, lambda x: CAST(greatest(0, least(255, round((x - lo) * 255 / (hi - lo)))) AS INT)) AS codes FROM r)
SELECT vec_id, list_sum(codes) AS code_sum, round(lo, 6) AS lo, round(hi, 6) AS hi,
       round(sqrt(list_sum(list_transform(list_zip(v, codes), lambda p: pow(p[1] - (lo + p[2] * (hi - lo) / 255), 2)))), 6) AS distance FROM q""")
def v9(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("q", T.sq8("v"))
    total = F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, c: s + c)
    return rows.select("vec_id", total.alias("code_sum"), F.round("q.lo", 6).alias("lo"), F.round("q.hi", 6).alias("hi"), F.round(T.sq8_distance("v", F.col("q")), 6).alias("distance"))


@query("v11_cosine", """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cosine,
       round(sqrt(list_inner_product(a.v, a.v)), 6) AS norm FROM g a JOIN g b ON b.vec_id = a.vec_id + 1""")
def v11(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return g.join(b, "vec_id").select("vec_id", F.round(T.cosine("v", "w"), 6).alias("cosine"), F.round(T.norm("v"), 6).alias("norm"))


DOC_IDS_SQL = """
doc_words AS (
  SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS w FROM documents
), doc_ids AS (
  SELECT d.id, coalesce(t.token_id, CAST('0x' || substr(md5(d.w), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)) AS token_id FROM doc_words d LEFT JOIN tokens t ON d.w = t.word
)"""


@query("v14_text_embedding", "WITH " + TOKENS_SQL + "," + DOC_IDS_SQL + """
SELECT i.id, count(*) AS words, round(avg(t.embedding[1] * 80.0), 6) AS q1, round(avg(t.embedding[64] * 80.0), 6) AS q64
FROM doc_ids i JOIN tokens t ON i.token_id = t.token_id GROUP BY i.id""")
def v14(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return K.embedded(docs, m, words=True).select("id", "words", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[63], 6).alias("q64"))


@query("v16_lm_head", ASK_SQL + """, lm AS (
  SELECT q.id, t.token_id, round(list_inner_product(t.embedding, q.q), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(t.embedding, q.q), 9) DESC, t.token_id) AS r
  FROM tokens t CROSS JOIN ask_q q)
SELECT id, token_id, round(score, 6) AS score, r AS rank FROM lm WHERE r <= 5""")
def v16(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    rows = best(K.embedded(asked(m), m), m.tokens.select("token_id", "embedding"), 5, ["token_id"], left_vector="q", right_vector="embedding", key=["id"])
    return six(rows.select("id", "token_id", "score", "rank"), "score")


@query("v25_store_stats", MODEL_SQL + " SELECT layer, count(*) AS features, count(token) AS labelled, round(avg(c_score), 6) AS mean_score FROM features GROUP BY layer")
def v25(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d).features.groupBy("layer").agg(F.count("*").alias("features"), F.count("token").alias("labelled"), F.round(F.avg("c_score"), 6).alias("mean_score"))


@query("f1_walk", ASK_SQL + " SELECT id, layer, rank, feature, round(score, 6) AS activation, coalesce(token, '') AS concept FROM hits WHERE rank <= 20")
def f1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.walk(asked(m), m), "activation")


ALSO_SQL = """, names AS (
  SELECT vec_id, token, logit, r, row_number() OVER (PARTITION BY vec_id ORDER BY r) AS i FROM features_top WHERE logit > 0 AND """ + readable_sql("token") + """
), also AS (SELECT vec_id, string_agg(token, ', ' ORDER BY i) AS also FROM names WHERE i <= 3 GROUP BY vec_id)"""


@query("f2_explain_walk", ASK_SQL + ALSO_SQL + f""" SELECT h.id, h.layer, {band_sql('h.layer')} AS band, h.feature, round(h.score, 6) AS activation, h.token, coalesce(a.also, '') AS also
FROM hits h LEFT JOIN also a ON h.feature = a.vec_id WHERE h.rank <= 5 AND h.token IS NOT NULL""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.explain_walk(asked(m), m), "activation")


@query("f3_similar_to", EVERY_SQL + """, near AS (SELECT * FROM hits WHERE rank <= 50),
pairs AS (SELECT a.id AS a, b.id AS b FROM asked a JOIN asked b ON b.id = a.id + 1),
shared AS (
  SELECT p.a AS id, max(least(x.score, y.score)) AS s FROM pairs p JOIN near x ON x.id = p.a JOIN near y ON y.id = p.b AND x.layer = y.layer AND x.feature = y.feature GROUP BY p.a
)
SELECT p.a AS id, round(CASE WHEN s.s > 0 THEN s.s ELSE 10 * list_inner_product(x.q, y.q) / (sqrt(list_inner_product(x.q, x.q)) * sqrt(list_inner_product(y.q, y.q))) END, 5) AS similarity
FROM pairs p JOIN ask_q x ON x.id = p.a JOIN ask_q y ON y.id = p.b LEFT JOIN shared s ON s.id = p.a""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    a = every(m)
    pairs = a.select("id", F.col("text").alias("a")).join(a.select((F.col("id") - 1).alias("id"), F.col("text").alias("b")), "id")
    return K.similarity(pairs, m).select("id", F.round("similarity", 5).alias("similarity"))


@query("f9_rank", EVERY_SQL + """, near AS (SELECT * FROM hits WHERE rank <= 50),
shared AS (SELECT x.id, max(least(x.score, y.score)) AS s FROM near x JOIN near y ON y.id = 7 AND x.layer = y.layer AND x.feature = y.feature GROUP BY x.id),
sim AS (
  SELECT x.id, CASE WHEN s.s > 0 THEN s.s ELSE 10 * list_inner_product(x.q, y.q) / (sqrt(list_inner_product(x.q, x.q)) * sqrt(list_inner_product(y.q, y.q))) END AS similarity
  FROM ask_q x JOIN ask_q y ON y.id = 7 LEFT JOIN shared s ON s.id = x.id)
SELECT id, round(similarity, 6) AS similarity, round(CASE WHEN similarity <= 0 THEN 1.7976931348623157e308 ELSE 1 / (1 + similarity) END, 6) AS distance FROM sim ORDER BY round(similarity, 6) DESC, id LIMIT 10""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    query_text = m.tokens.where("token_id = 7").first()["word"]
    return six(K.ranked(every(m), query_text, m, 10), "similarity", "distance")


DESCRIBE_SQL = EVERY_SQL + f""", kept AS (
  SELECT h.*, a.text AS entity, h.layer * 100000 + h.rank AS pos FROM hits h JOIN asked a ON h.id = a.id
  WHERE h.rank <= 20 AND h.score >= 5 AND h.token IS NOT NULL AND {content_sql('h.token')} AND lower(h.token) <> lower(a.text)
), sec_all AS (
  SELECT k.id, k.feature, t.token, t.r, row_number() OVER (PARTITION BY k.id, k.feature ORDER BY t.r) AS i
  FROM kept k JOIN features_top t ON t.vec_id = k.feature WHERE t.logit > 0 AND t.token <> k.token AND lower(t.token) <> lower(k.entity)
), sec AS (SELECT id, feature, list(token ORDER BY i) AS secondaries FROM sec_all WHERE i <= 5 AND {content_sql('token')} GROUP BY id, feature),
strong AS (
  SELECT k.*, coalesce(s.secondaries, []) AS secondaries FROM kept k LEFT JOIN sec s ON k.id = s.id AND k.feature = s.feature WHERE s.id IS NOT NULL OR k.score >= 20
), firsts AS (SELECT *, row_number() OVER (PARTITION BY id, lower(token) ORDER BY pos) AS f, row_number() OVER (PARTITION BY id, lower(token) ORDER BY score DESC, pos) AS b FROM strong),
described AS (
  SELECT f.id, f.token AS target, b.score AS confidence, b.layer, b.secondaries,
         lower(substr(f.token, 1, 1)) <> substr(f.token, 1, 1) AND upper(substr(f.token, 1, 1)) = substr(f.token, 1, 1) AS cap,
         regexp_matches(lower(array_to_string(b.secondaries, ' ')), '{GEO}') AS geo
  FROM firsts f JOIN firsts b ON f.id = b.id AND lower(f.token) = lower(b.token) AND f.f = 1 AND b.b = 1
), related AS (
  SELECT *, CASE WHEN layer < 3 THEN 'related_to' WHEN layer >= 7 THEN 'similar_to' WHEN cap AND confidence > 30 THEN 'part_of' WHEN cap AND geo THEN 'located_in'
            WHEN cap THEN 'instance_of' WHEN confidence > 20 THEN 'has_property' ELSE 'related_to' END AS relation FROM described
)"""


@query("f10_describe", DESCRIBE_SQL + " SELECT id, relation, target, round(confidence, 6) AS confidence, layer FROM related")
def f10(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.describe(every(m), m), "confidence")


@query("f11_describe_layers", DESCRIBE_SQL + f""", als AS (
  SELECT k.id, k.feature, t.token, row_number() OVER (PARTITION BY k.id, k.feature ORDER BY t.r) AS i FROM kept k JOIN features_top t ON t.vec_id = k.feature
  WHERE t.logit > 0 AND t.token <> k.token AND lower(t.token) <> lower(k.entity) AND {readable_sql('t.token')}
), al AS (SELECT id, feature, string_agg(token, ', ' ORDER BY i) AS also FROM als WHERE i <= 3 GROUP BY id, feature)
SELECT k.id, k.layer, k.feature, k.token AS target, round(k.score, 6) AS gate_score, coalesce(a.also, '') AS also FROM kept k LEFT JOIN al a ON a.id = k.id AND a.feature = k.feature""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.describe_layers(every(m), m), "gate_score")


@query("f12_implies", DESCRIBE_SQL + """, ask_pairs AS (SELECT a.id, t.word AS object FROM asked a JOIN tokens t ON t.token_id = (a.id * 3 + 1) % (SELECT count(*) FROM embeddings))
SELECT p.id, EXISTS (SELECT 1 FROM related r WHERE r.id = p.id AND lower(r.target) = lower(p.object)) AS implied FROM ask_pairs p""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    pairs = every(m).withColumn("o", (F.col("id") * 3 + 1) % m.size).join(m.tokens.select(F.col("token_id").alias("o"), F.col("word").alias("object")), "o")
    return K.implies(pairs.select("id", F.col("text").alias("subject"), "object"), m)


@query("f13_nearest_to", ASK_SQL + ALSO_SQL + """ SELECT h.id, h.feature, h.token, round(h.score, 6) AS score, coalesce(a.also, '') AS also
FROM hits h LEFT JOIN also a ON h.feature = a.vec_id WHERE h.layer = 4 AND h.rank <= 20 AND h.token IS NOT NULL""")
def f13(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(K.nearest_to(asked(m), m, 4), "score")


@query("f14_show_layers", f"SELECT label AS layer, {band_sql('label')} AS band, count(*) AS num_features FROM embeddings GROUP BY label")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return K.show_layers(derive(spark, d))


@query("f15_show_features", MODEL_SQL + ALSO_SQL + """ SELECT f.feature, f.token, round(f.c_score, 6) AS score, coalesce(a.also, '') AS also FROM features f LEFT JOIN also a ON f.feature = a.vec_id
WHERE f.layer = 5 AND f.c_score >= 0 AND contains(lower(f.token), 'e') ORDER BY f.feature LIMIT 50""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return six(K.show_features(derive(spark, d), 5, "E"), "score")


@query("f16_show_relations", MODEL_SQL + f""", good AS (
  SELECT * FROM features WHERE layer BETWEEN 4 AND 7 AND c_score >= 0.2 AND {content_sql('token')}
), ex AS (
  SELECT lower(g.token) AS relation, t.token AS example, min(g.layer * 1000000 + g.feature * 10 + t.r) AS pos FROM good g JOIN features_top t ON t.vec_id = g.feature AND t.r <= 2
  WHERE {readable_sql('t.token')} GROUP BY 1, 2
), exr AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY pos) AS i FROM ex),
exs AS (SELECT relation, string_agg(example, ', ' ORDER BY i) AS examples FROM exr WHERE i <= 3 GROUP BY relation),
ls AS (SELECT relation, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) AS layers FROM (SELECT DISTINCT lower(token) AS relation, layer FROM good) GROUP BY relation)
SELECT lower(g.token) AS relation, count(*) AS count, round(max(g.c_score), 6) AS max_score, any_value(ls.layers) AS layers, any_value(exs.examples) AS examples
FROM good g JOIN ls ON ls.relation = lower(g.token) JOIN exs ON exs.relation = lower(g.token) GROUP BY lower(g.token) ORDER BY count DESC, relation LIMIT 30""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return six(K.show_relations(derive(spark, d)), "max_score")


@query("f17_diff", "WITH " + TOKENS_SQL + "," + features_sql() + "," + features_sql(11, 3, "other") + """, both_sides AS (
  SELECT coalesce(a.layer, b.layer) AS layer, coalesce(a.feature, b.feature) AS feature, a.token AS token_a, b.token AS token_b, a.c_score AS score_a, b.c_score AS score_b
  FROM (SELECT * FROM features WHERE token IS NOT NULL AND layer <> 9) a FULL JOIN (SELECT * FROM other WHERE token IS NOT NULL AND layer <> 0) b ON a.layer = b.layer AND a.feature = b.feature
), s AS (SELECT *, CASE WHEN token_b IS NULL THEN 'removed' WHEN token_a IS NULL THEN 'added' WHEN token_a <> token_b OR abs(score_a - score_b) > 0.01 THEN 'modified' END AS status FROM both_sides)
SELECT layer, feature, token_a, token_b, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, status FROM s WHERE status IS NOT NULL""")
def f17(spark: SparkSession, d: str) -> DataFrame:
    a, b = derive(spark, d), derive(spark, d, 11, 3)
    a = Model(a.name, a.tokens, a.features.where("layer <> 9"), a.layers, a.size)
    b = Model(b.name, b.tokens, b.features.where("layer <> 0"), b.layers, b.size)
    return six(K.feature_diff(a, b, top=None), "score_a", "score_b")


TOKEN_LIST_SQL = "WITH t AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT r_name FROM region UNION SELECT n_name FROM nation UNION SELECT p_brand FROM part)"


def token_list(spark: SparkSession, d: str) -> DataFrame:
    parts = [("part", "p_name"), ("customer", "c_mktsegment"), ("region", "r_name"), ("nation", "n_name"), ("part", "p_brand")]
    out = None
    for name, col in parts:
        rows = spark.read.parquet(f"{d}/{name}.parquet").select(F.col(col).alias("t"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


@query("s1_readable", TOKEN_LIST_SQL + f" SELECT t, {readable_sql('t')} AS readable, {content_sql('t')} AS content FROM t")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return token_list(spark, d).select("t", T.is_readable("t").alias("readable"), T.is_content("t").alias("content"))


@query("s8_valid_entity", TOKEN_LIST_SQL + """ SELECT t, length(trim(t)) > 0 AND (regexp_matches(trim(t), '^[0-9]') OR (lower(substr(trim(t), 1, 1)) <> substr(trim(t), 1, 1)))
  AND NOT starts_with(lower(trim(t)), 'the ') AND NOT starts_with(lower(trim(t)), 'a ') AND len(string_split_regex(trim(t), '\\s+')) <= 4 AS valid,
  replace('The brand of {subject} is', '{subject}', t) AS prompt FROM t""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return token_list(spark, d).select("t", T.is_valid_entity("t").alias("valid"), T.filled(F.lit("The brand of {subject} is"), "t").alias("prompt"))


# --- graph ----------------------------------------------------------------------------------------------

GRAPH_SQL = """
WITH raw AS (
  SELECT 'N' || n_nationkey AS subject, 'in_region' AS relation, 'R' || n_regionkey AS object, 1.0::DOUBLE AS confidence, 'manual' AS source FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'in_nation', 'N' || c_nationkey, floor((c_acctbal + 1000) / 11000 * 10000 + 0.5) / 10000, 'document' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'in_nation', 'N' || s_nationkey, floor((s_acctbal + 1000) / 11000 * 10000 + 0.5) / 10000, 'wikidata' FROM supplier
  UNION ALL SELECT 'S' || l_suppkey, 'supplies', 'P' || l_partkey, round(0.5 + ((n + l_partkey * 7) % 50) / 100.0::DOUBLE, 4), 'parametric' FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
  UNION ALL SELECT 'P' || p_partkey, 'has_brand', p_brand, 0.8::DOUBLE, 'installed' FROM part
), edges AS (SELECT subject || '|' || relation || '|' || object AS seq, * FROM raw)"""


@query("g1_deduplicate", GRAPH_SQL + """, twice AS (SELECT seq, subject, relation, object, confidence, source FROM edges UNION ALL SELECT seq || '~', subject, relation, object, confidence + 0.05, source FROM edges WHERE source = 'wikidata'),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object ORDER BY confidence DESC, seq) AS n FROM twice)
SELECT subject, relation, object, round(confidence, 6) AS confidence FROM r WHERE n = 1""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    more = e.where("source = 'wikidata'").withColumns({"confidence": F.col("confidence") + 0.05, "seq": F.concat("seq", F.lit("~"))})
    return six(G.deduplicate(e.unionByName(more)).select("subject", "relation", "object", "confidence"), "confidence")


@query("g3_remove_edges", GRAPH_SQL + " SELECT subject, relation, object FROM edges WHERE NOT (relation = 'supplies' AND confidence < 0.7)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    return G.remove_edges(e, e.where("relation = 'supplies' and confidence < 0.7")).select("subject", "relation", "object")


@query("g6_describe_entity", GRAPH_SQL + " SELECT subject, relation, object, 'out' AS direction FROM edges WHERE subject = 'N3' UNION ALL SELECT subject, relation, object, 'in' FROM edges WHERE object = 'N3'")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return G.describe_entity(G.business_graph(spark, d), "N3").select("subject", "relation", "object", "direction")


@query("g7_exists", GRAPH_SQL + """ SELECT c_custkey, EXISTS (SELECT 1 FROM edges e WHERE e.subject = 'C' || c_custkey AND e.relation = 'in_nation' AND e.object = 'N' || (c_custkey % 25)) AS found FROM customer""")
def g7(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    asked_ = c.select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("subject"), F.lit("in_nation").alias("relation"), F.concat(F.lit("N"), F.col("c_custkey") % 25).alias("object"))
    return G.exists(G.business_graph(spark, d), asked_).select("c_custkey", "found")


HOPS_SQL = GRAPH_SQL + """, hop AS (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY confidence DESC, seq DESC) AS n FROM edges)"""


@query("g8_walk", HOPS_SQL + """ SELECT a.subject AS start, a.object || '/' || b.object AS path FROM hop a JOIN hop b ON b.subject = a.object AND b.relation = 'has_brand' AND b.n = 1 WHERE a.relation = 'supplies' AND a.n = 1""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    found = G.walk(e, e.where("relation = 'supplies'").select(F.col("subject").alias("start")).distinct(), ["supplies", "has_brand"])
    return found.select("start", F.array_join(F.slice("path", 2, 2), "/").alias("path"))


@query("g9_all_paths", HOPS_SQL + """, p AS (SELECT a.subject AS start, a.object || '/' || b.object AS path, least(a.confidence, b.confidence) AS confidence,
  row_number() OVER (PARTITION BY a.subject ORDER BY least(a.confidence, b.confidence) DESC, a.object, b.object) AS n
  FROM edges a JOIN edges b ON b.subject = a.object AND b.relation = 'has_brand' WHERE a.relation = 'supplies') SELECT start, path, round(confidence, 6) AS confidence FROM p WHERE n <= 5""")
def g9(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    found = G.walk_all_paths(e, e.where("relation = 'supplies'").select(F.col("subject").alias("start")).distinct(), ["supplies", "has_brand"], 5)
    return six(found.select("start", F.array_join(F.slice("path", 2, 2), "/").alias("path"), "confidence"), "confidence")


@query("g10_search", GRAPH_SQL + """, tok AS (SELECT DISTINCT seq, unnest(string_split_regex(replace(lower(subject || ' ' || relation || ' ' || object), '-', ' '), '\\s+')) AS w FROM edges)
SELECT e.subject, e.relation, e.object, count(*) AS score FROM tok JOIN edges e ON e.seq = tok.seq WHERE w IN ('n3', 'in_nation', 'c10') GROUP BY e.subject, e.relation, e.object ORDER BY score DESC, e.subject || '|' || e.relation || '|' || e.object LIMIT 10""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return G.search(G.business_graph(spark, d), "N3 in_nation C10", 10).select("subject", "relation", "object", "score")


@query("g12_bfs", GRAPH_SQL + """, d1 AS (SELECT DISTINCT object AS node FROM edges WHERE subject = 'S1'), d2 AS (SELECT DISTINCT e.object AS node FROM edges e JOIN d1 ON e.subject = d1.node)
SELECT node, min(depth) AS depth FROM (SELECT 'S1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs(G.business_graph(spark, d), "S1", 2)


@query("g11_subgraph", GRAPH_SQL + """, d1 AS (SELECT 'S1' AS node UNION SELECT object FROM edges WHERE subject = 'S1') SELECT subject, relation, object FROM edges WHERE subject IN (SELECT node FROM d1)""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(G.business_graph(spark, d), "S1", 1).select("subject", "relation", "object")


@query("g14_shortest_paths", GRAPH_SQL + """, p1 AS (SELECT object AS node, min(1 - confidence) AS cost FROM edges WHERE subject = 'S2' GROUP BY 1),
p2 AS (SELECT e.object AS node, min(p1.cost + (1 - e.confidence)) AS cost FROM edges e JOIN p1 ON e.subject = p1.node GROUP BY 1)
SELECT node, round(min(cost), 6) AS cost FROM (SELECT 'S2' AS node, 0.0::DOUBLE AS cost UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY node""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return six(G.shortest_paths(G.business_graph(spark, d), "S2").select("node", "cost"), "cost")


def _pagerank_sql(rounds: int) -> str:
    out = GRAPH_SQL + """, nodes AS (SELECT subject AS node FROM edges UNION SELECT object FROM edges), n AS (SELECT count(*) AS n FROM nodes),
deg AS (SELECT subject, count(*) AS degree FROM edges GROUP BY subject), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"""
    for i in range(rounds):
        out += f""", g{i} AS (SELECT e.object AS node, sum(r.rank / d.degree) AS got FROM edges e JOIN deg d ON e.subject = d.subject JOIN r{i} r ON r.node = e.subject GROUP BY 1),
x{i} AS (SELECT coalesce(sum(r.rank), 0) AS lost FROM r{i} r LEFT JOIN deg d ON d.subject = r.node WHERE d.subject IS NULL),
r{i + 1} AS (SELECT r.node, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + x.lost / n.n) AS rank FROM r{i} r LEFT JOIN g{i} g ON g.node = r.node, n, x{i} x)"""
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("g16_pagerank", _pagerank_sql(6))
def g16(spark: SparkSession, d: str) -> DataFrame:
    ranks, _, _ = G.pagerank(G.business_graph(spark, d), max_rounds=6, tolerance=0.0)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


def _components_sql(rounds: int) -> str:
    """Least labels of neighbours, ``rounds`` times: enough for a graph whose nodes are not farther from their least one."""
    out = GRAPH_SQL + """, links AS MATERIALIZED (SELECT subject AS a, object AS b FROM edges UNION SELECT object, subject FROM edges UNION SELECT subject, subject FROM edges UNION SELECT object, object FROM edges),
l0 AS (SELECT DISTINCT a AS node, a AS label FROM links)"""
    for i in range(rounds):
        out += f", l{i + 1} AS MATERIALIZED (SELECT k.a AS node, min(l.label) AS label FROM links k JOIN l{i} l ON l.node = k.b GROUP BY k.a)"
    return out


@query("g17_components", _components_sql(10) + ", h AS (SELECT label, count(*) AS size FROM l10 GROUP BY label) SELECT l.node, l.label AS component, h.size FROM l10 l JOIN h ON h.label = l.label")
def g17(spark: SparkSession, d: str) -> DataFrame:
    return G.components(G.business_graph(spark, d))


@query("g18_connected", _components_sql(10) + """ SELECT x.a, x.b, x.a = x.b OR coalesce(la.label = lb.label, false) AS connected FROM (
  SELECT 'P' || p_partkey AS a, 'C' || p_partkey AS b FROM part) x LEFT JOIN l10 la ON la.node = x.a LEFT JOIN l10 lb ON lb.node = x.b""")
def g18(spark: SparkSession, d: str) -> DataFrame:
    """Parts and customers of equal numbers, some of which there are not."""
    pairs = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("a"), F.concat(F.lit("C"), "p_partkey").alias("b"))
    return G.are_connected(G.business_graph(spark, d), pairs)


OTHER_SQL = GRAPH_SQL.replace("edges AS (", "edges AS MATERIALIZED (") + """, both_sides AS (
  SELECT subject, relation, object, confidence AS cb, source AS sb, NULL::DOUBLE AS cn, NULL::VARCHAR AS sn FROM edges WHERE relation <> 'in_region'
  UNION ALL SELECT subject, relation, object, NULL, NULL, CASE WHEN relation = 'in_nation' THEN 0.5 ELSE confidence END, CASE WHEN relation = 'supplies' THEN 'manual' ELSE 'unknown' END FROM edges WHERE relation <> 'has_brand'
  UNION ALL SELECT 'X' || n_nationkey, 'twin', 'N' || n_nationkey, NULL, NULL, 0.3, 'manual' FROM nation
), sides AS (SELECT subject, relation, object, max(cb) AS cb, max(sb) AS sb, max(cn) AS cn, max(sn) AS sn FROM both_sides GROUP BY subject, relation, object)"""


def priority_sql(source: str) -> str:
    return f"CASE {source} " + " ".join(f"WHEN '{name}' THEN {value}" for name, value in G.PRIORITY.items()) + " ELSE 0 END"


def other_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = G.business_graph(spark, d)
    changed = e.where("relation <> 'has_brand'").withColumns({
        "confidence": F.when(F.col("relation") == "in_nation", 0.5).otherwise(F.col("confidence")),
        "source": F.when(F.col("relation") == "supplies", "manual").otherwise("unknown")})
    n = spark.read.parquet(f"{d}/nation.parquet")
    twin = n.select(F.concat(F.lit("X"), "n_nationkey").alias("subject"), F.lit("twin").alias("relation"), F.concat(F.lit("N"), "n_nationkey").alias("object"), F.lit(0.3).alias("confidence"), F.lit("manual").alias("source"), F.lit("").alias("seq"))
    return e.where("relation <> 'in_region'"), changed.unionByName(twin)


for _strategy, _better in (("union", "false"), ("max_confidence", "cn > cb"), ("source_priority", f"{priority_sql('sn')} > {priority_sql('sb')}")):

    @query(f"g19_merge_{_strategy}", OTHER_SQL + f""", j AS (SELECT *, CASE WHEN sb IS NULL THEN 'added' WHEN sn IS NOT NULL AND ({_better}) THEN 'updated' ELSE 'kept' END AS origin FROM sides)
SELECT subject, relation, object, round(CASE WHEN origin = 'kept' THEN cb ELSE cn END, 6) AS confidence, CASE WHEN origin = 'kept' THEN sb ELSE sn END AS source, origin FROM j""")
    def g19(spark: SparkSession, d: str, strategy: str = _strategy) -> DataFrame:
        return six(G.merge(*other_graph(spark, d), strategy), "confidence")


@query("g20_diff", OTHER_SQL + """ SELECT subject, relation, object, status FROM (SELECT *, CASE WHEN sb IS NULL THEN 'added' WHEN sn IS NULL THEN 'removed' WHEN abs(cb - cn) > 2.220446049250313e-16 THEN 'changed' END AS status FROM sides)
WHERE status IS NOT NULL""")
def g20(spark: SparkSession, d: str) -> DataFrame:
    return G.diff(*other_graph(spark, d)).select("subject", "relation", "object", "status")


@query("g21_filter", GRAPH_SQL + " SELECT subject, relation, object FROM edges WHERE confidence >= 0.3 AND confidence <= 0.9 AND relation IN ('in_nation', 'supplies') AND source IN ('document', 'parametric') AND contains(subject, '1') AND contains(object, '2')")
def g21(spark: SparkSession, d: str) -> DataFrame:
    return G.filtered(G.business_graph(spark, d), min_confidence=0.3, max_confidence=0.9, relations=["in_nation", "supplies"], sources=["document", "parametric"], subject_contains="1", object_contains="2").select("subject", "relation", "object")


@query("g22_stats", _components_sql(10) + """ SELECT count(*) AS edges, count(DISTINCT relation) AS relations, round(avg(confidence), 6) AS avg_confidence, (SELECT count(*) FROM l10) AS entities,
  round(2.0 * count(*) / (SELECT count(*) FROM l10), 6) AS avg_degree, (SELECT count(DISTINCT label) FROM l10) AS components,
  (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM edges GROUP BY source)) AS by_source FROM edges""")
def g22(spark: SparkSession, d: str) -> DataFrame:
    found = G.stats(G.business_graph(spark, d))
    sources = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return six(found.withColumn("by_source", sources), "avg_confidence", "avg_degree")


@query("g23_nodes", GRAPH_SQL + """, e2 AS (SELECT subject AS node, relation, 1 AS o, 0 AS i FROM edges UNION ALL SELECT object, relation, 0, 1 FROM edges)
SELECT node, count(*) AS degree, sum(o) AS out_degree, sum(i) AS in_degree,
  CASE WHEN max(CASE WHEN o = 1 AND relation = 'supplies' THEN 1 ELSE 0 END) = 1 THEN 'supplier' WHEN max(CASE WHEN i = 1 AND relation = 'supplies' OR o = 1 AND relation = 'has_brand' THEN 1 ELSE 0 END) = 1 THEN 'part'
       WHEN max(CASE WHEN i = 1 AND relation = 'in_nation' THEN 1 ELSE 0 END) = 1 THEN 'nation' END AS node_type FROM e2 GROUP BY node""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "supplier", ["supplies"], []), (2, "part", ["has_brand"], ["supplies"]), (3, "nation", [], ["in_nation"])], "rule_no int, node_type string, outgoing array<string>, incoming array<string>")
    return G.nodes(G.business_graph(spark, d), rules)


@query("g24_counts", GRAPH_SQL + " SELECT relation, source, count(*) AS edges, round(avg(confidence), 6) AS avg_confidence FROM edges GROUP BY 1, 2")
def g24(spark: SparkSession, d: str) -> DataFrame:
    return six(G.counts(G.business_graph(spark, d)), "avg_confidence")


# --- patches ---------------------------------------------------------------------------------------------

# Patch 0 renames every 7th feature, patch 1 deletes every 14th, patch 2 gives every 21st a new gate (its neighbour's) and label.
PATCHED_SQL = MODEL_SQL + """, ops AS (
  SELECT 0 AS patch_no, feature AS op_no, 'update' AS op, layer, feature, 'Renamed' AS target FROM features WHERE feature % 7 = 0
  UNION ALL SELECT 1, feature, 'delete', layer, feature, NULL FROM features WHERE feature % 14 = 0
  UNION ALL SELECT 2, feature, 'insert', layer, feature, 'Inserted' FROM features WHERE feature % 21 = 0
), last_op AS (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY patch_no DESC, op_no DESC) AS n FROM ops),
patched AS (
  SELECT f.layer, f.feature, CASE WHEN o.op IS NULL THEN f.token WHEN o.op = 'delete' THEN NULL ELSE o.target END AS token,
    CASE WHEN o.op IS NULL THEN f.c_score WHEN o.op = 'delete' THEN NULL WHEN o.op = 'insert' THEN 0.9 ELSE f.c_score END AS c_score,
    CASE WHEN f.feature % 21 = 0 THEN g.gate WHEN f.feature % 14 = 0 THEN NULL ELSE f.gate END AS gate
  FROM features f LEFT JOIN last_op o ON o.n = 1 AND o.layer = f.layer AND o.feature = f.feature LEFT JOIN gates g ON g.vec_id = (f.feature + 1) % (SELECT count(*) FROM embeddings)
)"""


def patch_ops(m: Model) -> DataFrame:
    f = m.features
    null, none = F.lit(None), F.lit(None).cast("array<double>")

    def ops(no: int, op: str, every: int, target, gate) -> DataFrame:
        return f.where(F.col("feature") % every == 0).select(
            F.lit(no).alias("patch_no"), F.col("feature").cast("int").alias("op_no"), F.lit(op).alias("op"), "layer", "feature", target.cast("string").alias("target"), null.cast("long").alias("token_id"),
            null.cast("double").alias("confidence"), gate.alias("gate"), null.cast("string").alias("entity"), null.cast("string").alias("relation"))

    near = f.select(((F.col("feature") - 1 + m.size) % m.size).alias("feature"), F.col("gate").alias("near"))
    inserts = ops(2, "insert", 21, F.lit("Inserted"), none).drop("gate").join(near, "feature").withColumnRenamed("near", "gate")
    return ops(0, "update", 7, F.lit("Renamed"), none).unionByName(ops(1, "delete", 14, null, none)).unionByName(inserts)


@query("p1_apply_patches", PATCHED_SQL + " SELECT layer, feature, token, round(c_score, 6) AS c_score, round(gate[1], 6) AS g1 FROM patched")
def p1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(P.overlay(m.features, patch_ops(m)).select("layer", "feature", "token", "c_score", F.col("gate")[0].alias("g1")), "c_score", "g1")


@query("p2_remove_patch", MODEL_SQL + """ SELECT layer, feature, CASE WHEN feature % 21 = 0 THEN 'Inserted' WHEN feature % 7 = 0 THEN 'Renamed' ELSE token END AS token FROM features""")
def p2(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return P.overlay(m.features, P.without_patch(patch_ops(m), 1)).select("layer", "feature", "token")


@query("p4_overlay_knn", PATCHED_SQL + """, asked AS (SELECT token_id AS id, word AS text FROM tokens WHERE token_id % 20 = 0), ask_q AS (SELECT a.id, list_transform(t.embedding, lambda x: x * 80.0) AS q FROM asked a JOIN tokens t ON a.text = t.word),
sc AS (SELECT q.id, f.layer, f.feature, f.token, round(list_inner_product(f.gate, q.q), 9) AS score FROM patched f CROSS JOIN ask_q q WHERE f.gate IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY abs(score) DESC, feature) AS rank FROM sc) SELECT id, layer, feature, token, rank, round(score, 6) AS score FROM h WHERE rank <= 5""")
def p4(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    view = P.overlay(m.features, patch_ops(m)).where("gate is not null")
    return six(K.gate_knn(K.embedded(asked(m), m), view, 5).select("id", "layer", "feature", "token", "rank", "score"), "score")


@query("p8_patch_counts", MODEL_SQL + """ SELECT 0 AS patch_no, 0 AS inserts, count(*) AS updates, 0 AS deletes FROM features WHERE feature % 7 = 0 UNION ALL SELECT 1, 0, 0, count(*) FROM features WHERE feature % 14 = 0
UNION ALL SELECT 2, count(*), 0, 0 FROM features WHERE feature % 21 = 0""")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return P.patch_counts(patch_ops(derive(spark, d)))


@query("p9_free_feature", MODEL_SQL + " SELECT layer, min(feature) AS feature FROM features WHERE token IS NULL GROUP BY layer")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return P.free_feature(derive(spark, d).features)


@query("p10_find_features", MODEL_SQL + " SELECT DISTINCT f.layer, f.feature, f.token FROM features f JOIN features_top t ON t.vec_id = f.feature WHERE contains(lower(t.token), 'th') OR contains(lower(f.token), 'th')")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return P.find_features(derive(spark, d).features, "TH").select("layer", "feature", "token")


KNN_SQL = ASK_SQL + """, entries AS (SELECT label AS layer, vec_id, gate AS key FROM gates WHERE vec_id % 9 = 0 AND vec_id % 27 <> 0),
s AS (SELECT q.id, e.layer, e.vec_id, round(list_inner_product(e.key, q.q) / (sqrt(list_inner_product(e.key, e.key)) * sqrt(list_inner_product(q.q, q.q))), 9) AS cosine FROM entries e CROSS JOIN ask_q q),
r AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY cosine DESC, vec_id) AS rank FROM s)"""


def knn_ops(m: Model) -> DataFrame:
    base = m.features.where("feature % 9 = 0").select(
        F.lit(0).alias("patch_no"), F.col("feature").cast("int").alias("op_no"), F.lit("insert_knn").alias("op"), "layer", "feature", F.concat(F.lit("T"), "feature").alias("target"),
        F.lit(None).cast("long").alias("token_id"), F.lit(0.9).alias("confidence"), "gate", F.concat(F.lit("E"), "feature").alias("entity"), F.lit("is").alias("relation"))
    gone = base.where("feature % 27 = 0").withColumns({"patch_no": F.lit(1), "op": F.lit("delete_knn"), "entity": F.lower("entity"), "relation": F.lit(None).cast("string"), "gate": F.lit(None).cast("array<double>")})
    return base.unionByName(gone)


@query("p6_knn_store", KNN_SQL + " SELECT id, layer, 'T' || vec_id AS target, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 2")
def p6(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    q = K.embedded(asked(m), m).crossJoin(spark.range(m.layers).select(F.col("id").cast("int").alias("layer")))
    return six(P.knn_query(P.knn_entries(knn_ops(m)), q, 2).select("id", "layer", "target", "cosine", "rank"), "cosine")


# --- clustering, probing, traces -----------------------------------------------------------------------------


@query("c1_kmeans")
def c1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    got, _ = C.kmeans(m.features.select(F.col("feature").alias("id"), F.col("gate").alias("v")), 8, 10)
    return got.select("id", "cluster", F.round("distance", 6).alias("distance"))


LABELS_SQL = MODEL_SQL + f""", w AS (SELECT f.layer AS cluster, lower(t.token) AS w FROM features f JOIN features_top t ON t.vec_id = f.feature WHERE f.token IS NOT NULL),
good AS (SELECT * FROM w WHERE octet_length(encode(w)) >= 3 AND 2 * length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) >= length(w) AND w NOT IN ({", ".join(f"'{w}'" for w in LABEL_STOP_WORDS)})), tf AS (SELECT cluster, w, count(*) AS n FROM good GROUP BY 1, 2),
sc AS (SELECT t.cluster, t.w, t.n, t.n / CAST(a.total AS DOUBLE) * ln(CAST((SELECT count(*) FROM features WHERE token IS NOT NULL) AS DOUBLE) / e.total) AS score FROM tf t JOIN (SELECT cluster, sum(n) AS total FROM tf GROUP BY 1) a ON a.cluster = t.cluster
  JOIN (SELECT w, sum(n) AS total FROM tf GROUP BY 1) e ON e.w = t.w), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, n DESC, w) AS r FROM sc),
plain AS (SELECT c.cluster, coalesce(l.label, 'cluster-' || c.cluster) AS label FROM (SELECT DISTINCT cluster FROM w) c LEFT JOIN (SELECT cluster, string_agg(w, '/' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY cluster) l ON l.cluster = c.cluster)"""


@query("c2_tfidf_labels", LABELS_SQL + " SELECT cluster, label FROM plain")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return C.tfidf_labels(_members(derive(spark, d))).select("cluster", "label")


def _members(m: Model) -> DataFrame:
    return m.with_meta.select(F.col("layer").alias("cluster"), "feature", F.array_join(F.transform("top_k", lambda t: t["token"]), "|").alias("text"))


def _categories(m: Model) -> DataFrame:
    return m.tokens.where("token_id % 10 = 5").select(F.col("token_id").alias("position"), "word")


def pattern_sql(words: str) -> str:
    """What at least half of a list of words are."""
    known = " ".join(f"WHEN 2 * len(list_filter({words}, lambda w: w IN ({', '.join(repr(w) for w in of)}))) >= len({words}) THEN '{name}'" for name, of in (("language", LANGUAGES), ("country", COUNTRIES), ("month", MONTHS), ("number", NUMBERS)))
    return f"CASE {known} WHEN 2 * len(list_filter({words}, lambda w: regexp_full_match(w, '[a-z]{{0,4}}'))) >= len({words}) THEN 'morphological' END"


@query("c3_category_labels", LABELS_SQL + f""", unit AS (SELECT token_id, word, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS v FROM tokens WHERE token_id > 2),
own AS (SELECT r.cluster, u.v FROM r JOIN unit u ON u.word = r.w WHERE r.r <= 5), mean_sim AS (SELECT o.cluster, c.token_id, c.word, round(avg(list_inner_product(o.v, c.v)), 9) AS s FROM own o CROSS JOIN unit c WHERE c.token_id % 10 = 5 GROUP BY 1, 2, 3),
near AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, token_id) AS n FROM mean_sim), members AS (SELECT cluster, list(w ORDER BY r) AS ws FROM r WHERE r <= 5 GROUP BY cluster),
pattern AS (SELECT cluster, {pattern_sql('ws')} AS pattern FROM members)
SELECT p.cluster, coalesce(n.word, CASE WHEN p.cluster IN (SELECT cluster FROM own) THEN t.pattern END, p.label) AS label FROM plain p LEFT JOIN near n ON n.cluster = p.cluster AND n.n = 1 AND n.s >= 0.25 LEFT JOIN pattern t ON t.cluster = p.cluster""")
def c3(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return L.category_labels(_members(m), m.tokens, _categories(m)).select("cluster", "label")


@query("c10_relation_labels", LABELS_SQL + " SELECT f.layer, f.feature, p.label AS relation FROM features f JOIN plain p ON p.cluster = f.layer WHERE f.feature % 3 <> 0")
def c10(spark: SparkSession, d: str) -> DataFrame:
    """Two of three features are assigned to their layer's cluster, the others to none."""
    m = derive(spark, d)
    placed = m.features.where("feature % 3 <> 0").select("layer", "feature", F.col("layer").alias("cluster"))
    return L.relation_labels(placed, C.tfidf_labels(_members(m)))


@query("c15_labelled_clusters")
def c15(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    rows = R.offset_directions(m.with_meta, R.gate_tokens(m.with_meta, m.tokens), m.tokens).join(
        m.with_meta.select("layer", "feature", F.col("token").alias("out_token"), F.array_join(F.transform("top_k", lambda t: t["token"]), "|").alias("text")), ["layer", "feature"])
    _, clusters = L.labelled_clusters(rows, m.tokens, _categories(m), k=16, max_rounds=10)
    return clusters.select("cluster", "label", "count")


@query("c7_probe", ASK_SQL + " SELECT layer, feature, count(*) AS entities, min(id) AS first FROM hits WHERE rank <= 3 AND score > 5 GROUP BY layer, feature")
def c7(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return C.probe(K.embedded(asked(m), m), m.features).select("layer", "feature", F.size("entities").cast("long").alias("entities"), F.col("entities")[0].alias("first"))


@query("c22_nearest_centre", """WITH g AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id AS cluster, v AS centre FROM g WHERE vec_id < 10),
s AS (SELECT g.vec_id, c.cluster, round(list_inner_product(g.v, c.centre) / (sqrt(list_inner_product(g.v, g.v)) * sqrt(list_inner_product(c.centre, c.centre))), 9) AS s FROM g CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) AS n FROM s)
SELECT vec_id AS id, cluster, round(s, 6) AS cosine FROM r WHERE n = 1""")
def c22(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return six(C.classify_direction(g, g.where("id < 10").select(F.col("id").alias("cluster"), F.col("v").alias("centre"))), "cosine")


WALKER_SQL = MODEL_SQL + """, ci AS (SELECT f.layer, f.feature, t.token AS subject, t.token_id, round(list_inner_product(f.gate, t.embedding), 9) AS c_in FROM features f CROSS JOIN tokens t),
cr AS (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY c_in DESC, token_id) AS r FROM ci WHERE c_in >= 0.02),
ed AS (SELECT c.layer, c.feature, c.subject, o.token AS object, c.c_in, o.logit AS c_out FROM cr c JOIN features_top o ON o.vec_id = c.feature AND o.logit >= 0.02 WHERE c.r <= 5),
walked AS (SELECT *, c_in * c_out / max(c_in * c_out) OVER (PARTITION BY layer) AS confidence, c_in / max(c_in) OVER (PARTITION BY layer) AS selectivity FROM ed)"""


@query("w1_weight_walk", WALKER_SQL + " SELECT layer, feature, subject, object, round(confidence, 6) AS confidence, round(selectivity, 6) AS selectivity FROM walked")
def w1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(C.weight_walk(m.with_meta, m.tokens).select("layer", "feature", "subject", "object", "confidence", "selectivity"), "confidence", "selectivity")


@query("w2_layer_stats", WALKER_SQL + """ SELECT layer, count(*) AS edges, round(avg(confidence), 6) AS mean_confidence, round(max(confidence), 6) AS max_confidence, round(min(confidence), 6) AS min_confidence, round(avg(selectivity), 6) AS mean_selectivity,
  count(*) FILTER (WHERE subject = object) AS self_loops, count(*) FILTER (WHERE confidence >= 0.25) AS confidence_ge_25, count(*) FILTER (WHERE selectivity >= 0.75) AS selectivity_ge_75 FROM walked GROUP BY layer""")
def w2(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    stats = C.layer_stats(C.weight_walk(m.with_meta, m.tokens))
    names = ["mean_confidence", "max_confidence", "min_confidence", "mean_selectivity"]
    return six(stats.select("layer", "edges", *names, "self_loops", "confidence_ge_25", "selectivity_ge_75"), *names)


TRACE_SQL = "WITH " + TOKENS_SQL + """, tn AS (SELECT vec_id // 10 AS trace_id, vec_id % 10 AS layer, gate AS residual FROM gates),
lg AS (SELECT n.trace_id, n.layer, t.token_id, round(list_inner_product(n.residual, t.embedding), 9) AS logit FROM tn n CROSS JOIN tokens t),
pr AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY trace_id, layer) AS probability, rank() OVER (PARTITION BY trace_id, layer ORDER BY logit DESC) AS rank FROM lg)"""


@query("w7_answer_trajectory", TRACE_SQL + " SELECT trace_id, layer, rank, round(probability, 6) AS probability FROM pr WHERE token_id = 5")
def w7(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    nodes = m.features.select(F.floor(F.col("feature") / 10).alias("trace_id"), (F.col("feature") % 10).alias("layer"), F.col("gate").alias("residual"))
    return six(C.answer_trajectory(nodes, m.tokens, 5), "probability")


@query("m1_predictions", TRACE_SQL + """, m AS (SELECT trace_id * 10 + layer AS id, token_id, tanh(logit / 0.5) * 0.5 / 0.7 AS x FROM lg), p AS (SELECT id, token_id, exp(x) / sum(exp(x)) OVER (PARTITION BY id) AS probability, row_number() OVER (PARTITION BY id ORDER BY round(x, 12) DESC, token_id) AS rank FROM m)
SELECT id, token_id, round(probability, 6) AS probability, rank FROM p WHERE rank <= 3""")
def m1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    nodes = m.features.select(F.col("feature").alias("id"), F.col("gate").alias("residual"))
    return six(C.predictions(nodes, m.tokens, 3, 0.7, 0.5), "probability")


# --- events ---------------------------------------------------------------------------------------------------


@query("st_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def st1(spark: SparkSession, d: str) -> DataFrame:
    from quillon.streaming.events import event_windows

    return event_windows(spark.read.parquet(f"{d}/events.parquet"))


@query("st_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def st2(spark: SparkSession, d: str) -> DataFrame:
    from quillon.streaming.events import sessions

    return sessions(spark.read.parquet(f"{d}/events.parquet"))


@query("st_token_windows", "SELECT conv_id AS id, turn // 4 AS window, min(turn) AS first, max(turn) AS last, max_by(role, turn) AS boundary FROM conversations GROUP BY 1, 2")
def st3(spark: SparkSession, d: str) -> DataFrame:
    from quillon.streaming.events import token_windows

    return token_windows(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("role").alias("value")), 4)


# --- registry, routing, approximate search ----------------------------------------------------------------------


ROUTE_SQL = ASK_SQL + """, rt AS (SELECT q.id, g.label AS layer, g.vec_id AS expert, round(list_inner_product(g.gate, q.q) + (g.vec_id % 3) * 0.5, 9) AS score FROM gates g CROSS JOIN ask_q q),
rr AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY score DESC, expert) AS rank FROM rt), top AS (SELECT *, max(score) OVER (PARTITION BY id, layer) AS most FROM rr WHERE rank <= 3),
routed AS (SELECT id, layer, expert, rank, score, exp(score - most) / sum(exp(score - most)) OVER (PARTITION BY id, layer) AS probability FROM top)"""


@query("v17_route", ROUTE_SQL + " SELECT id, layer, expert, rank, round(score, 6) AS score, round(probability, 6) AS probability FROM routed")
def v17(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(R.route(K.embedded(asked(m), m).withColumnRenamed("q", "x"), router(m), 3), "score", "probability")


def router(m: Model) -> DataFrame:
    return m.features.select("layer", F.col("feature").alias("expert"), F.col("gate").alias("w"), ((F.col("feature") % 3) * 0.5).alias("bias"), F.lit(1.0).alias("scale"))


@query("v18_route_totals", ROUTE_SQL + " SELECT id, expert, count(*) AS times, round(avg(probability), 6) AS mean_probability FROM routed GROUP BY id, expert")
def v18(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(R.routed_totals(R.route(K.embedded(asked(m), m).withColumnRenamed("q", "x"), router(m), 3)), "mean_probability")


@query("v8_approximate_knn", ASK_SQL + " SELECT id, count(*) AS exact, true AS good FROM hits WHERE rank <= 10 GROUP BY id")
def v8(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each query against the exact search; good from 0.9 on."""
    m = derive(spark, d)
    q, f = R.stored(K.embedded(asked(m), m), "asked-vectors"), m.features.select("layer", "feature", "gate")
    return R.recall(R.approximate_knn(q, f, 10), K.gate_knn(q, f, 10)).select("id", "exact", (F.col("recall") >= 0.9).alias("good"))


@query("c12_gate_tokens", MODEL_SQL + """, ww AS (SELECT * FROM tokens WHERE octet_length(encode(trim(token))) >= 3 AND regexp_matches(trim(token), '^[A-Za-z0-9''-]+$')),
sg AS (SELECT f.layer, f.feature, w.token_id, round(list_inner_product(f.gate, w.embedding), 9) AS score FROM features f CROSS JOIN ww w), rg AS (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY score DESC, token_id) AS r FROM sg)
SELECT layer, feature, token_id, round(score, 6) AS score FROM rg WHERE r = 1""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(R.gate_tokens(m.features, m.tokens), "score")


@query("w6_token_gate_index", MODEL_SQL + """, ac AS (SELECT f.layer, f.feature, t.token_id, list_inner_product(f.gate, t.embedding) AS x FROM features f CROSS JOIN tokens t), sl AS (SELECT layer, feature, token_id, round(x / (1 + exp(-x)), 9) AS act FROM ac),
rk AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY abs(act) DESC, layer, feature) AS rank FROM sl) SELECT layer, feature, token_id, round(act, 6) AS act, rank FROM rk WHERE rank <= 5""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(R.token_gate_index(m.features, m.tokens, 5), "act")


@query("w10_walk_residuals", MODEL_SQL + """, rs AS (SELECT vec_id // 10 AS id, CAST(vec_id % 10 AS INT) AS layer, gate AS q FROM gates), s AS (SELECT r.id, f.layer, f.feature, f.token, round(list_inner_product(f.gate, r.q), 9) AS score FROM features f JOIN rs r ON r.layer = f.layer),
k AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY abs(score) DESC, feature) AS rank FROM s) SELECT id, layer, rank, feature, round(score, 6) AS score, token FROM k WHERE rank <= 20 AND token IS NOT NULL""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    r = m.features.select(F.floor(F.col("feature") / 10).alias("id"), (F.col("feature") % 10).cast("int").alias("layer"), F.col("gate").alias("q"))
    return six(R.walk_residuals(r, m.features), "score")


@query("w11_covariance", """WITH g AS (SELECT label AS layer, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ij AS (SELECT i, j FROM range(64) a(i), range(64) b(j))
SELECT layer, i, j, round(avg(v[i + 1] * v[j + 1]), 6) AS value FROM g CROSS JOIN ij GROUP BY layer, i, j""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return six(R.covariance(g), "value")
