"""Further queries of the store, patch, graph, labelling, text and source operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import queries as Q
from quillon.functions import sql as named
from quillon.functions import text as T
from quillon.operators import clustering as C
from quillon.operators import graph as G
from quillon.operators import knowledge as K
from quillon.operators import labelling as L
from quillon.operators import models as R
from quillon.operators import patches as P
from quillon.operators import ranking as H
from quillon.operators import registries as S
from quillon.plans.model import derive
from quillon.queries import ASK_SQL, EVERY_SQL, GRAPH_SQL, MODEL_SQL, PATCHED_SQL, Query, asked, every, six
from quillon.sources import graphs as IO
from quillon.staging import new_path, staged

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- graph ---------------------------------------------------------------------------------------------


@query("g1_add_edges", GRAPH_SQL + """, more AS (SELECT * FROM edges UNION ALL SELECT seq || '~', subject, relation, object, confidence + 0.5, source FROM edges WHERE source <> 'manual' UNION ALL SELECT seq || '#', object, 'of', subject, confidence * 2, source FROM edges WHERE relation = 'in_nation'),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object ORDER BY seq) AS n FROM more) SELECT subject, relation, object, round(greatest(0, least(1, confidence)), 6) AS confidence FROM r WHERE n = 1""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    again = e.where("source <> 'manual'").withColumns({"confidence": F.col("confidence") + 0.5, "seq": F.concat("seq", F.lit("~"))})
    back = e.where("relation = 'in_nation'").select(F.col("object").alias("subject"), F.lit("of").alias("relation"), F.col("subject").alias("object"), (F.col("confidence") * 2).alias("confidence"), "source", F.concat("seq", F.lit("#")).alias("seq"))
    return six(G.add_edges(e, again.unionByName(back)).select("subject", "relation", "object", "confidence"), "confidence")


@query("g4_select", GRAPH_SQL + " SELECT 'out' AS way, subject, relation, object FROM edges WHERE subject = 'S3' AND relation = 'supplies' UNION ALL SELECT 'in', subject, relation, object FROM edges WHERE object = 'N7' AND relation = 'in_nation'")
def g4(spark: SparkSession, d: str) -> DataFrame:
    e = G.business_graph(spark, d)
    out, into = G.select(e, subject="S3", relation="supplies"), G.select(e, relation="in_nation", obj="N7")
    return out.withColumn("way", F.lit("out")).unionByName(into.withColumn("way", F.lit("in"))).select("way", "subject", "relation", "object")


@query("g13_dfs")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return G.dfs(G.business_graph(spark, d), "S1", 3)


@query("g15_astar", GRAPH_SQL + """, target AS (SELECT min(p_brand) AS t FROM part), p1 AS (SELECT object AS node, min(1 - confidence) AS cost FROM edges WHERE subject = 'S2' GROUP BY 1)
SELECT round(min(p1.cost + (1 - e.confidence)), 6) AS cost, 3 AS steps FROM edges e JOIN p1 ON e.subject = p1.node WHERE e.object = (SELECT t FROM target) HAVING count(*) > 0""")
def g15(spark: SparkSession, d: str) -> DataFrame:
    """The way from a supplier to the first brand; no part's brand is nearer than 0.2, which is the heuristic."""
    e = G.business_graph(spark, d)
    target = e.where("relation = 'has_brand'").agg(F.min("object")).first()[0]
    rest = e.where("relation = 'has_brand'").select(F.col("subject").alias("node"), F.lit(0.19).alias("h")).distinct()
    return six(G.astar(e, "S2", target, rest).select("cost", F.size("path").alias("steps")), "cost")


@query("g24_lists", GRAPH_SQL + " SELECT 'relation' AS kind, relation AS name, count(*) AS n FROM edges GROUP BY 2 UNION ALL SELECT 'entity', node, count(*) FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 2")
def g24(spark: SparkSession, d: str) -> DataFrame:
    e = staged(G.business_graph(spark, d), "lists")
    entities = G.nodes(e).select(F.lit("entity").alias("kind"), F.col("node").alias("name"), F.col("degree").alias("n"))
    return G.counts(e).groupBy(F.col("relation").alias("name")).agg(F.sum("edges").alias("n")).select(F.lit("relation").alias("kind"), "name", "n").unionByName(entities)


@query("g25_crawl", GRAPH_SQL + """, d0 AS (SELECT subject, relation, object, confidence, 0 AS depth FROM edges WHERE relation = 'in_nation' AND subject LIKE 'C%' AND confidence >= 0.3),
d1 AS (SELECT DISTINCT e.subject, e.relation, e.object, e.confidence, 1 AS depth FROM edges e JOIN d0 ON d0.object = e.subject WHERE e.relation = 'in_region')
SELECT subject, relation, object, round(confidence, 6) AS confidence, depth FROM d0 UNION ALL SELECT * FROM d1""")
def g25(spark: SparkSession, d: str) -> DataFrame:
    """Customers are asked where they are; their nations in turn."""
    e = staged(G.business_graph(spark, d).where("relation in ('in_nation', 'in_region')"), "crawl-known")
    known = e.select(F.concat("subject", F.lit(" is "), "relation").alias("prompt"), F.col("object").alias("answer"), F.col("confidence").alias("probability"))
    templates = spark.createDataFrame([("in_nation", "{subject} is in_nation"), ("in_region", "{subject} is in_region")], "relation string, template string")
    seeds = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("entity"))
    found = G.extract_bfs(seeds, templates, lambda rows: rows.join(known, "prompt"), max_entities=10_000_000)
    return six(found.select("subject", "relation", "object", "confidence", "depth"), "confidence")


@query("g27_mock_answers", "SELECT e.event_id, CASE WHEN e.event_id % 10 < 5 THEN ' is' END AS token, CASE WHEN e.event_id % 10 < 5 THEN CASE WHEN e.event_id % 10 = 3 THEN 0.9 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS probability FROM events e")
def g27(spark: SparkSession, d: str) -> DataFrame:
    """Prompts end in their number; 0 to 4 are known, 3 also by a longer ending."""
    known = spark.createDataFrame([(f" ends {i}", "is known", 0.5) for i in range(5)] + [("prompt ends 3 ", "is known better", 0.9)], "suffix string, answer string, probability double")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("a prompt ends "), F.col("event_id") % 10).alias("prompt"))
    return S.mock_answers(e, known).select("event_id", S.top_token("predictions").alias("token"), S.top_probability("predictions").alias("probability"))


@query("g31_edge_defaults", "SELECT 'P' || p_partkey AS subject, 'size' AS relation, CAST(p_size AS VARCHAR) AS object, CASE WHEN p_size > 25 THEN 1.0 ELSE p_size / 25.0 END::DOUBLE AS confidence, 'unknown' AS source, 0 AS n FROM part")
def g31(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("subject"), F.lit("size").alias("relation"), F.col("p_size").cast("string").alias("object"), (F.col("p_size") / 25).alias("confidence"))
    return G.edges_of(rows).withColumn("n", F.size("metadata")).drop("metadata")


# --- sources ---------------------------------------------------------------------------------------------

EDGES_SQL = GRAPH_SQL + " SELECT subject, relation, object, round(confidence, 6) AS confidence, source FROM edges"


def _back(rows: DataFrame) -> DataFrame:
    return six(rows.select("subject", "relation", "object", "confidence", "source"), "confidence")


@query("io_graph_log", EDGES_SQL)
def io_log(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "graph") + ".ndjson"
    IO.append_log(G.business_graph(spark, d), path)
    return _back(IO.load(spark, path))


@query("io_graph_csv", EDGES_SQL)
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "graph") + ".csv"
    IO.write_csv(G.business_graph(spark, d), path)
    return _back(IO.load(spark, path))


# --- patches ---------------------------------------------------------------------------------------------


@query("p5_bake", PATCHED_SQL + " SELECT layer, feature, token, round(c_score, 6) AS c_score FROM patched")
def p5(spark: SparkSession, d: str) -> DataFrame:
    from quillon.sources.stores import bake

    m = derive(spark, d)
    path = new_path(spark, "baked")
    bake(P.overlay(m.features, Q.patch_ops(m)), path)
    return six(spark.read.parquet(path).select("layer", "feature", "token", "c_score"), "c_score")


@query("p10_find_relations", Q.LABELS_SQL + " SELECT f.layer, f.feature FROM features f JOIN plain p ON p.cluster = f.layer WHERE f.token IS NOT NULL AND contains(lower(p.label), 'e') AND f.layer = 3")
def p10(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    labels = L.relation_labels(m.features.select("layer", "feature", F.col("layer").alias("cluster")), C.tfidf_labels(Q._members(m)))
    return P.find_features(m.features.join(labels, ["layer", "feature"]), relation="E", layer=3).select("layer", "feature")


@query("p13_facts", "SELECT n_nationkey AS id, p_size AS cycle, p_partkey AS pos FROM part JOIN nation ON lower(p_brand) = lower('BRAND#' || (n_nationkey % 5 + 1) || (n_nationkey // 5 + 1)) AND (n_nationkey % 2 = 0 OR p_type LIKE '%a%')")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a fact about its brand; nations ask for a brand each, odd ones for one of two relations."""
    p = spark.read.parquet(f"{d}/part.parquet")
    facts = p.select(F.col("p_size").alias("cycle"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("entity"), F.when(F.contains("p_type", F.lit("a")), "Made").otherwise("Sold").alias("relation"))
    n = F.col("n_nationkey")
    brand = F.concat(F.lit("BRAND#"), (n % 5 + 1).cast("string"), (F.floor(n / 5) + 1).cast("string"))
    wanted = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("id"), brand.alias("entity"), F.when(n % 2 == 1, "MADE").alias("relation"))
    return P.facts_of(facts, wanted).select("id", "cycle", "pos")


@query("p14_compact_status", MODEL_SQL + """, f AS (SELECT * FROM features) SELECT (SELECT count(*) FROM f WHERE feature % 7 = 0) + (SELECT count(*) FROM f WHERE feature % 14 = 0) + (SELECT count(*) FROM f WHERE feature % 21 = 0) + (SELECT count(*) FROM f WHERE feature % 9 = 0) + (SELECT count(*) FROM f WHERE feature % 27 = 0) AS epoch,
  (SELECT count(*) FROM f WHERE feature % 9 = 0 AND feature % 27 <> 0) AS l0_entries, (SELECT count(*) FROM f WHERE feature % 7 = 0) AS l1_edges, (SELECT count(DISTINCT layer) FROM f WHERE feature % 21 = 0) AS l1_layers_used, 0 AS l2_facts, 0 AS l2_cycles,
  (SELECT count(DISTINCT layer) FROM f) AS base_layers, (SELECT count(*) FROM f WHERE layer = 0) AS base_features, 64 AS hidden_dim, false AS memit_supported""")
def p14(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return P.compact_status(m.features, Q.patch_ops(m).unionByName(Q.knn_ops(m)))


@query("p17_overlay_walk", PATCHED_SQL + """, asked AS (SELECT token_id AS id, word AS text FROM tokens WHERE token_id % 20 = 0), ask_q AS (SELECT a.id, list_transform(t.embedding, lambda x: x * 80.0) AS q FROM asked a JOIN tokens t ON a.text = t.word),
sc AS (SELECT q.id, f.layer, f.feature, f.token, round(list_inner_product(f.gate, q.q), 9) AS score FROM patched f CROSS JOIN ask_q q WHERE f.gate IS NOT NULL AND f.layer IN (4, 5)),
h AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY abs(score) DESC, feature) AS rank FROM sc) SELECT id, layer, feature, token, rank FROM h WHERE rank <= 8 AND token IS NOT NULL""")
def p17(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return P.overlay_walk(K.embedded(asked(m), m), P.overlay(m.features, Q.patch_ops(m)), 8, [4, 5]).select("id", "layer", "feature", "token", "rank")


@query("p18_entry_counts", MODEL_SQL + " SELECT layer, count(*) AS entries FROM features WHERE feature % 9 = 0 AND feature % 27 <> 0 GROUP BY layer")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return P.entry_counts(P.knn_entries(Q.knn_ops(derive(spark, d))))


@query("p19_epochs", MODEL_SQL + """, o AS (SELECT 0 AS patch_no, feature AS op_no FROM features WHERE feature % 7 = 0 UNION ALL SELECT 1, feature FROM features WHERE feature % 14 = 0 UNION ALL SELECT 2, feature FROM features WHERE feature % 21 = 0),
n AS (SELECT *, row_number() OVER (ORDER BY patch_no, op_no) AS epoch FROM o) SELECT patch_no, op_no, epoch, (epoch - 1) % 10 + 1 AS since_minor, (epoch - 1) % 50 + 1 AS since_major FROM n""")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return P.epochs(Q.patch_ops(derive(spark, d)), 10, 50).drop("op")


@query("p7_override", Q.KNN_SQL + """, first_hit AS (SELECT id, min_by(vec_id, layer) AS v FROM r WHERE rank = 1 AND cosine > 0.3 GROUP BY id),
lm AS (SELECT q.id, t.token, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(t.embedding, q.q), 9) DESC, t.token_id) AS rank FROM tokens t CROSS JOIN ask_q q), raw AS (SELECT * FROM lm WHERE rank <= 3)
SELECT * FROM (SELECT id, 1 AS rank, 'T' || v AS token FROM first_hit UNION ALL SELECT raw.id, raw.rank + CASE WHEN f.id IS NULL THEN 0 ELSE 1 END, raw.token FROM raw LEFT JOIN first_hit f ON f.id = raw.id) WHERE rank <= 3""")
def p7(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators.products import best

    m = derive(spark, d)
    q = K.embedded(asked(m), m)
    raw = best(q, m.tokens.select("token_id", "token", "embedding"), 3, [F.col("token_id")], left_vector="q", right_vector="embedding", key=["id"])
    by_layer = q.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(m.layers - 1))))
    hits = P.knn_query(P.knn_entries(Q.knn_ops(m)), by_layer, 1)
    return P.knn_override(raw.select("id", "rank", "token", F.col("score").alias("probability")), hits, 3, 0.3).select("id", "rank", "token")


# --- labels, directions, universes -----------------------------------------------------------------------

PAIRS_SQL = MODEL_SQL + """, ww AS (SELECT * FROM tokens WHERE octet_length(encode(trim(token))) >= 3 AND regexp_matches(trim(token), '^[A-Za-z0-9''-]+$')),
sg AS (SELECT f.layer, f.feature, w.token_id, w.token, w.embedding, row_number() OVER (PARTITION BY f.layer, f.feature ORDER BY round(list_inner_product(f.gate, w.embedding), 9) DESC, w.token_id) AS r FROM features f CROSS JOIN ww w),
pairs AS (SELECT f.layer AS cluster, f.layer, f.feature, g.token AS in_token, f.token AS out_token, g.token_id AS in_id, f.token_id AS out_id, g.embedding AS e_in FROM features f JOIN sg g ON g.layer = f.layer AND g.feature = f.feature AND g.r = 1 WHERE f.token IS NOT NULL),
db AS (SELECT DISTINCT 'rel' || feature % 4 AS relation, lower(in_token) AS subject_lc, lower(out_token) AS object_lc FROM pairs WHERE feature % 3 = 0)"""


def _pairs(m) -> tuple[DataFrame, DataFrame]:
    ins = R.gate_tokens(m.with_meta, m.tokens).join(m.tokens.select("token_id", F.col("token").alias("in_token")), "token_id")
    rows = m.with_meta.select("layer", "feature", F.col("token").alias("out_token")).join(ins.select("layer", "feature", "in_token"), ["layer", "feature"]).withColumn("cluster", F.col("layer"))
    rows = staged(rows, "pairs")
    db = rows.where("feature % 3 = 0").select(F.concat(F.lit("rel"), F.col("feature") % 4).alias("relation"), F.lower("in_token").alias("subject_lc"), F.lower("out_token").alias("object_lc")).distinct()
    return rows, db


@query("c4_pair_labels", PAIRS_SQL + """, n AS (SELECT cluster, count(*) AS n FROM pairs GROUP BY 1), h AS (SELECT p.cluster, d.relation, count(*) AS hits FROM pairs p JOIN db d ON d.subject_lc = lower(p.in_token) AND d.object_lc = lower(p.out_token) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY hits DESC, relation DESC) AS r FROM h) SELECT b.cluster, b.relation, b.hits FROM b JOIN n ON n.cluster = b.cluster WHERE b.r = 1 AND b.hits >= greatest(2, floor(n.n / 10.0))""")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_labels(*_pairs(derive(spark, d)))


@query("c5_output_labels", PAIRS_SQL + """, few AS (SELECT * FROM db WHERE relation IN ('rel0', 'rel1')), h AS (SELECT p.cluster, d.relation, count(*) AS hits FROM pairs p JOIN (SELECT DISTINCT relation, object_lc FROM few) d ON d.object_lc = lower(p.out_token) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY hits DESC, relation) AS r, lead(hits, 1, 0) OVER (PARTITION BY cluster ORDER BY hits DESC, relation) AS next FROM h) SELECT cluster, relation, hits FROM b WHERE r = 1 AND hits >= 2 AND hits >= 2 * next""")
def c5(spark: SparkSession, d: str) -> DataFrame:
    rows, db = _pairs(derive(spark, d))
    return C.output_labels(rows, db.where("relation in ('rel0', 'rel1')"))


@query("c6_known_relations", PAIRS_SQL + " SELECT p.layer, p.feature, d.relation FROM pairs p JOIN db d ON d.subject_lc = lower(p.in_token) AND d.object_lc = lower(p.out_token)")
def c6(spark: SparkSession, d: str) -> DataFrame:
    rows, db = _pairs(derive(spark, d))
    wanted = rows.select(F.struct("layer", "feature").alias("id"), F.upper("in_token").alias("subject"), F.col("out_token").alias("object"))
    return L.known_relations(db, wanted).select("id.layer", "id.feature", "relation")


@query("c9_confirmed_pairs", EVERY_SQL + """, p AS (SELECT layer, feature, id FROM hits WHERE rank <= 3 AND score > 5), few AS (SELECT layer, feature FROM p GROUP BY 1, 2 HAVING count(DISTINCT id) <= 20)
SELECT DISTINCT p.layer, p.feature, p.id AS entity, f.token FROM p JOIN few w ON w.layer = p.layer AND w.feature = p.feature JOIN features f ON f.layer = p.layer AND f.feature = p.feature WHERE octet_length(encode(f.token)) >= 2""")
def c9(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return C.confirmed_pairs(C.probe(K.embedded(every(m), m), m.features), m.features)


@query("c13_directions", PAIRS_SQL + """, dd AS (SELECT p.layer, p.feature, p.out_id, list_transform(list_zip(o.embedding, p.e_in), lambda z: z[1] - z[2]) AS v FROM pairs p JOIN tokens o ON o.token_id = p.out_id)
SELECT layer, feature, CASE WHEN out_id > 2 AND sqrt(list_inner_product(v, v)) > 1e-12 THEN round(v[1] / sqrt(list_inner_product(v, v)), 6) END AS d1 FROM dd""")
def c13(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(R.offset_directions(m.with_meta, R.gate_tokens(m.with_meta, m.tokens), m.tokens).select("layer", "feature", F.col("direction")[0].alias("d1")), "d1")


@query("s13_entity_pattern", Q.LABELS_SQL + f""", members AS (SELECT cluster, list(w ORDER BY r) AS ws FROM r WHERE r <= 5 GROUP BY cluster) SELECT cluster, {Q.pattern_sql('ws')} AS pattern FROM members""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return C.tfidf_labels(Q._members(derive(spark, d))).where(F.size("tokens") > 0).select("cluster", L.entity_pattern("tokens").alias("pattern"))


@query("w9_template_universe", ASK_SQL + " SELECT id % 40 AS template, layer, count(DISTINCT feature) AS n, min(feature) AS first FROM hits WHERE abs(score) > 15 AND rank <= 30 GROUP BY 1, 2")
def w9(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    hits = K.gate_knn(K.embedded(asked(m), m), m.features, 30).withColumn("template", F.col("id") % 40)
    found = R.template_universe(hits, 15.0)
    return found.select("template", "layer", F.size("features").cast("long").alias("n"), F.col("features")[0].alias("first"))


@query("w6_looked_up", MODEL_SQL + """, ac AS (SELECT f.layer, f.feature, t.token_id, list_inner_product(f.gate, t.embedding) AS x FROM features f CROSS JOIN tokens t), sl AS (SELECT layer, feature, token_id, round(x / (1 + exp(-x)), 9) AS act FROM ac),
rk AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY abs(act) DESC, layer, feature) AS rank FROM sl), ix AS (SELECT * FROM rk WHERE rank <= 5),
w AS (SELECT token_id // 3 AS id, layer, feature, arg_max(act, struct_pack(a := abs(act), b := act)) AS act FROM ix GROUP BY 1, 2, 3), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(act) DESC, layer, feature) AS rank FROM w)
SELECT id, layer, feature, round(act, 6) AS act, rank FROM z WHERE rank <= 4""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    wanted = m.tokens.select(F.floor(F.col("token_id") / 3).alias("id"), "token_id")
    return six(R.looked_up(R.token_gate_index(m.features, m.tokens, 5), wanted, 4), "act")


W2_SQL = Q.WALKER_SQL


@query("w2_top_entities", W2_SQL + """, e AS (SELECT layer, 'subject' AS side, subject AS entity, confidence FROM walked UNION ALL SELECT layer, 'object', object, confidence FROM walked),
c AS (SELECT layer, side, entity, count(*) AS n, avg(confidence) AS mean FROM e GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY layer, side ORDER BY n DESC, round(mean, 9) DESC, entity) AS rank FROM c)
SELECT layer, side, entity, n, round(mean, 6) AS mean_confidence, rank FROM k WHERE rank <= 10""")
def w2(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(C.top_entities(C.weight_walk(m.with_meta, m.tokens), 10), "mean_confidence")


@query("w2_means", W2_SQL + " SELECT layer, round(avg(c_in), 6) AS mean_c_in, round(avg(c_out), 6) AS mean_c_out FROM walked GROUP BY layer")
def w2_means(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    return six(C.layer_stats(C.weight_walk(m.with_meta, m.tokens)).select("layer", "mean_c_in", "mean_c_out"), "mean_c_in", "mean_c_out")


@query("w7_layer_summaries", Q.TRACE_SQL + """, o AS (SELECT trace_id, layer, token_id, probability, row_number() OVER (PARTITION BY trace_id, layer ORDER BY logit DESC, token_id) AS r FROM pr)
SELECT o.trace_id, o.layer, o.token_id, round(o.probability, 6) AS probability, round(sqrt(list_inner_product(n.residual, n.residual)), 6) AS norm FROM o JOIN tn n ON n.trace_id = o.trace_id AND n.layer = o.layer WHERE o.r = 1""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    nodes = m.features.select(F.floor(F.col("feature") / 10).alias("trace_id"), (F.col("feature") % 10).alias("layer"), F.col("gate").alias("residual"))
    return six(C.layer_summaries(nodes, m.tokens), "probability", "norm")


# --- texts -----------------------------------------------------------------------------------------------


@query("f4_similar_to_many", EVERY_SQL + """, near AS (SELECT * FROM hits WHERE rank <= 50), pairs AS (SELECT a.id, k.pos, b.id AS b FROM asked a CROSS JOIN (VALUES (0, 1), (2, 7)) k(pos, step) JOIN asked b ON b.id = a.id + k.step WHERE a.id % 3 = 0),
shared AS (SELECT p.id, p.pos, max(least(x.score, y.score)) AS s FROM pairs p JOIN near x ON x.id = p.id JOIN near y ON y.id = p.b AND x.layer = y.layer AND x.feature = y.feature GROUP BY 1, 2),
v AS (SELECT p.id, p.pos, CASE WHEN s.s > 0 THEN s.s ELSE 10 * list_inner_product(x.q, y.q) / (sqrt(list_inner_product(x.q, x.q)) * sqrt(list_inner_product(y.q, y.q))) END AS s FROM pairs p JOIN ask_q x ON x.id = p.id JOIN ask_q y ON y.id = p.b LEFT JOIN shared s ON s.id = p.id AND s.pos = p.pos)
SELECT a.id, 3 AS n, round(v0.s, 5) AS first, NULL::DOUBLE AS second, round(v2.s, 5) AS third FROM asked a LEFT JOIN v v0 ON v0.id = a.id AND v0.pos = 0 LEFT JOIN v v2 ON v2.id = a.id AND v2.pos = 2 WHERE a.id % 3 = 0""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """Every third token against the next, against none, and against the seventh after it."""
    m = derive(spark, d)
    a = every(m)
    one, two = (a.select((F.col("id") - step).alias("id"), F.col("text").alias(f"t{step}")) for step in (1, 7))
    rows = a.where("id % 3 = 0").join(one, "id", "left").join(two, "id", "left").select("id", F.col("text").alias("a"), F.array("t1", F.lit(None).cast("string"), "t7").alias("texts"))
    s = K.similar_to_many(rows, m)
    five = lambda i: (F.round(F.col("similarities")[i] * 1e5) / 1e5)
    return s.select("id", F.size("similarities").alias("n"), five(0).alias("first"), five(1).alias("second"), five(2).alias("third"))


@query("f7_distances", EVERY_SQL + """, near AS (SELECT * FROM hits WHERE rank <= 50), pairs AS (SELECT a.id AS a, b.id AS b FROM asked a JOIN asked b ON b.id = a.id + 2),
shared AS (SELECT p.a AS id, max(least(x.score, y.score)) AS s FROM pairs p JOIN near x ON x.id = p.a JOIN near y ON y.id = p.b AND x.layer = y.layer AND x.feature = y.feature GROUP BY p.a),
v AS (SELECT p.a AS id, CASE WHEN s.s > 0 THEN s.s ELSE 10 * list_inner_product(x.q, y.q) / (sqrt(list_inner_product(x.q, x.q)) * sqrt(list_inner_product(y.q, y.q))) END AS s FROM pairs p JOIN ask_q x ON x.id = p.a JOIN ask_q y ON y.id = p.b LEFT JOIN shared s ON s.id = p.a)
SELECT id, round(CASE WHEN s <= 0 THEN 1.7976931348623157e308 ELSE 1 / (1 + s) END, 6) AS distance FROM v""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    a = every(m)
    return six(K.distances(a.select("id", F.col("text").alias("a")).join(a.select((F.col("id") - 2).alias("id"), F.col("text").alias("b")), "id"), m), "distance")


@query("q_named_walk", EVERY_SQL + " SELECT layer, rank, feature, round(score, 6) AS activation, coalesce(token, '') AS concept FROM hits WHERE id = 7 AND rank <= 5")
def named_walk(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    named.register(spark, m)
    word = m.tokens.where("token_id = 7").first()["word"]
    return six(spark.sql("SELECT layer, rank, feature, activation, concept FROM walk(:word, top => 5)", {"word": word}), "activation")


TRIGRAM_SQL = "(SELECT list_distinct(flatten(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3))))))"


@query("h1_hybrid_rank", EVERY_SQL + f""", near AS (SELECT * FROM hits WHERE rank <= 50), shared AS (SELECT x.id, max(least(x.score, y.score)) AS s FROM near x JOIN near y ON y.id = 7 AND x.layer = y.layer AND x.feature = y.feature GROUP BY x.id),
sim AS (SELECT x.id, CASE WHEN s.s > 0 THEN s.s ELSE 10 * list_inner_product(x.q, y.q) / (sqrt(list_inner_product(x.q, x.q)) * sqrt(list_inner_product(y.q, y.q))) END AS s FROM ask_q x JOIN ask_q y ON y.id = 7 LEFT JOIN shared s ON s.id = x.id),
t AS (SELECT a.id, a.text, (SELECT text FROM asked WHERE id = 7) AS asked_text FROM asked a),
g AS (SELECT id, {TRIGRAM_SQL.format(t='text')} AS x, {TRIGRAM_SQL.format(t='asked_text')} AS y, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tw, list_distinct(regexp_extract_all(lower(asked_text), '[\\p{{L}}\\p{{N}}]+')) AS qw FROM t),
k AS (SELECT g.id, 1 - least(CASE WHEN sim.s <= 0 THEN 1.0 ELSE 1 / (1 + sim.s) END, 1.0) AS near, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS trigram, len(list_intersect(qw, tw)) / CAST(len(qw) AS DOUBLE) AS words FROM g JOIN sim ON sim.id = g.id)
SELECT id, round(0.5 * near + 0.3 * trigram + 0.2 * words, 6) AS score, round(near, 6) AS near, round(trigram, 6) AS trigram, round(words, 6) AS words FROM k ORDER BY round(0.5 * near + 0.3 * trigram + 0.2 * words, 9) DESC, id LIMIT 20""")
def h1(spark: SparkSession, d: str) -> DataFrame:
    m = derive(spark, d)
    word = m.tokens.where("token_id = 7").first()["word"]
    return six(H.hybrid_rank(every(m), word, m, 20), "score", "near", "trigram", "words")


@query("s5_texts", """SELECT p_partkey, url_encode(p_name || '/' || p_brand) AS url, replace(p_type || '/' || p_name, '/', '--') AS slug, 'The ' || p_brand || ' of ' || p_type || ' is' AS prompt, round(p_retailprice / 7, 4) AS four FROM part""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    four = F.round(F.col("p_retailprice") / 7 * 1e4) / 1e4
    return p.select(
        "p_partkey", T.url_encoded(F.concat_ws("/", "p_name", "p_brand")).alias("url"), T.model_slug(F.concat_ws("/", "p_type", "p_name")).alias("slug"),
        T.filled(F.lit("The {subject} of {object} is"), "p_brand", "p_type").alias("prompt"), four.alias("four"))


@query("st3_last_positions", "SELECT conv_id AS id, turn AS pos, role AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def st3(spark: SparkSession, d: str) -> DataFrame:
    from quillon.streaming.events import last_positions

    return last_positions(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("role").alias("value")), 3)


@query("st1_replayed_log", GRAPH_SQL + " SELECT subject, relation, object FROM edges WHERE relation <> 'has_brand'")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """A log that is written twice over and taken over as it grows."""
    from quillon.streaming.events import replay_into

    e = G.business_graph(spark, d)
    log, table, marks = (new_path(spark, n) for n in ("log", "edges", "marks"))
    IO.append_log(e.where("relation = 'supplies'"), log)
    replay_into(spark, log, table, marks)
    IO.append_log(e.where("relation <> 'has_brand'"), log)
    replay_into(spark, log, table, marks)
    return spark.read.parquet(table).select("subject", "relation", "object")


@query("s14_chat_forms", """
SELECT conv_id, turn, f AS form, CASE f WHEN 'mistral' THEN '[INST] ' || text || ' [/INST]' WHEN 'plain' THEN text END AS wrapped, CASE WHEN f NOT IN ('mistral', 'plain') THEN contains(w, text) END AS inside, f AS family
FROM (SELECT *, ['gemma', 'mistral', 'llama', 'chatml', 'plain'][conv_id % 5 + 1] AS f, text AS w FROM conversations)""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    names, families = ["Some/GEMMA-9", "mixtral-x", "a-llama", "Qwen3", "other"], ["gemma3", "mixtral", "llama", "gpt_oss", "none"]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("conv_id") % 5 + 1).cast("int"))
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("form", T.chat_form(of(names)))
    w, plain = T.wrapped("text", F.col("form")), F.col("form").isin("mistral", "plain")
    return c.select("conv_id", "turn", "form", F.when(plain, w).alias("wrapped"), F.when(~plain, F.contains(w, F.col("text"))).alias("inside"), T.family_form(of(families)).alias("family"))


@query("v23_classify", """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - 0.01) AS v FROM embeddings), p AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings WHERE vec_id < 3),
z AS (SELECT g.vec_id, list(list_inner_product(g.v, p.c) ORDER BY p.k) AS z FROM g CROSS JOIN p GROUP BY g.vec_id), s AS (SELECT vec_id, z[1] - z[2] + 0.02 AS a, z[2] - z[3] AS b, z[3] - z[1] - 0.01 AS c FROM z)
SELECT vec_id AS id, CASE WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS route FROM s""")
def v23(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    g = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    axes = np.array([r.v for r in g.where("id < 3").orderBy("id").collect()], float)
    turns = np.array([[1.0, -1.0, 0.0], [0.0, 1.0, -1.0], [-1.0, 0.0, 1.0]])
    return R.classify(g, np.full(axes.shape[1], 0.01), axes, turns, np.array([0.02, 0.0, -0.01]), ["first", "second", "third"])


@query("w3_attention_walk", MODEL_SQL + """, hd AS (SELECT a.label AS layer, a.vec_id AS head, a.gate AS u, b.gate AS w FROM gates a JOIN gates b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
i AS (SELECT h.layer, h.head, t.token_id, t.token AS subject, list_inner_product(h.w, t.embedding) AS x, round(abs(list_inner_product(h.w, t.embedding)) * sqrt(list_inner_product(h.u, h.u)), 9) AS c_in, h.u FROM hd h CROSS JOIN tokens t),
ir AS (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY c_in DESC, token_id) AS r FROM i), o AS (SELECT i.layer, i.head, i.token_id, i.subject, i.c_in, t.token_id AS out_id, t.token AS object, round(i.x * list_inner_product(i.u, t.embedding), 9) AS c_out FROM ir i CROSS JOIN tokens t WHERE i.r <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY layer, head, token_id ORDER BY c_out DESC, out_id) AS r FROM o WHERE c_out >= 0.02)
SELECT 'L' || layer || '-H' || head AS relation, subject, object, round(c_in * c_out / max(c_in * c_out) OVER (PARTITION BY layer), 6) AS confidence, round(c_in / max(c_in) OVER (PARTITION BY layer), 6) AS selectivity FROM k WHERE r <= 2""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    """Heads of rank one, from pairs of neighbouring vectors."""
    m = derive(spark, d)
    g = m.features.select("layer", "feature", "gate")
    after = g.select((F.col("feature") - 1).alias("feature"), F.col("gate").alias("w"))
    heads = g.where("feature % 50 = 0").join(after, "feature").select("layer", F.col("feature").cast("int").alias("head"), F.transform("gate", lambda u: F.transform("w", lambda w: u * w)).alias("ov"))
    return six(C.attention_walk(heads, m.tokens, 2).select("relation", "subject", "object", "confidence", "selectivity"), "confidence", "selectivity")


@query("p15_build", PATCHED_SQL.replace("FROM features WHERE feature % 21 = 0\n)", "FROM features WHERE false\n)") + """, gone AS (SELECT DISTINCT f.layer, f.feature FROM features f JOIN features_top t ON t.vec_id = f.feature WHERE contains(lower(t.token), 'qu')),
free AS (SELECT min(feature) AS feature FROM features WHERE layer = 5 AND token IS NULL)
SELECT f.layer, f.feature, CASE WHEN f.layer = 5 AND f.feature = (SELECT feature FROM free) THEN 'Quay' WHEN g.feature IS NOT NULL THEN NULL ELSE f.token END AS token FROM features f LEFT JOIN gone g ON g.layer = f.layer AND g.feature = f.feature""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    """A build file that deletes by a target and then inserts into the first free feature, of the base that is, of the middle layer."""
    from quillon.sources.stores import build

    m = derive(spark, d)
    path = new_path(spark, "store")
    m.features.write.parquet(path)
    made, _ = build(spark, f'FROM {path}\nINSERT ("Harbour", "has", "Quay")\nDELETE "x" "y" "qu"\nSTAGE dev\nEXPOSE all\n')
    return made.select("layer", "feature", "token")
