"""The model's functions in Spark SQL, with named arguments and defaults: ``SELECT * FROM walk('the sea', top => 5)``.

They are temporary SQL functions over temporary views of a model's tables, so Catalyst plans their bodies into the
calling query; they may be called laterally. For whole tables of texts the DataFrame operators score in blocks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillon.plans.model import WORD, Model

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0.0D, (s, v) -> s + v)"


def _ids(text: str, last: bool) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}', 0)"
    picked = f"slice({words}, -1, 1)" if last else words
    return f"SELECT w.pos, coalesce(t.token_id, conv(substring(md5(w.word), 1, 8), 16, 10) % v.size) AS token_id FROM (SELECT posexplode(if(size({words}) = 0, array(), {picked})) AS (pos, word)) w CROSS JOIN model_size v LEFT JOIN model_tokens t ON t.word = w.word"


def _vector(text: str, last: bool, scale: float) -> str:
    """One row ``q``, the scaled mean of the words' embeddings, or none for a text without words."""
    return f"""SELECT transform(sort_array(collect_list(struct(dim, x))), e -> e.x) AS q FROM (
      SELECT e.dim, avg(e.x) * {scale}D AS x FROM ({_ids(text, last)}) i JOIN model_tokens m ON m.token_id = i.token_id LATERAL VIEW posexplode(m.embedding) e AS dim, x GROUP BY e.dim) HAVING count(*) > 0"""


def _hits(text: str, last: bool, scale: float) -> str:
    score = "round(" + _DOT.format(a="f.gate", b="v.q") + ", 9)"
    return f"""SELECT *, row_number() OVER (PARTITION BY layer ORDER BY abs(score) DESC, feature) AS rank FROM (
      SELECT f.layer, f.feature, f.token, {score} AS score FROM model_features f CROSS JOIN ({_vector(text, last, scale)}) v WHERE f.gate IS NOT NULL)"""


def register(spark: SparkSession, model: Model) -> None:
    """Create ``walk``, ``nearest``, ``similar_to`` and ``distance_of`` for this session, over ``model``."""
    model.tokens.createOrReplaceTempView("model_tokens")
    model.features.createOrReplaceTempView("model_features")
    spark.range(1).selectExpr(f"cast({model.size} as bigint) as size").createOrReplaceTempView("model_size")
    s = model.scale
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION walk(prompt STRING, top INT DEFAULT 20) RETURNS TABLE (layer INT, rank INT, feature BIGINT, activation DOUBLE, concept STRING)
      RETURN SELECT layer, rank, feature, score, coalesce(token, '') FROM ({_hits("walk.prompt", True, s)}) WHERE rank <= walk.top""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION nearest(entity STRING, in_layer INT, top INT DEFAULT 20) RETURNS TABLE (feature BIGINT, token STRING, score DOUBLE)
      RETURN SELECT feature, token, score FROM ({_hits("nearest.entity", False, s)}) WHERE layer = nearest.in_layer AND rank <= nearest.top AND token IS NOT NULL""")
    near = "SELECT layer, feature, score FROM ({}) WHERE rank <= 50"
    a, b = (near.format(_hits(f"similar_to.{x}", False, s)) for x in ("a", "b"))
    va, vb = (_vector(f"similar_to.{x}", False, s) for x in ("a", "b"))
    cosine = f"10 * {_DOT.format(a='x.q', b='y.q')} / (sqrt({_DOT.format(a='x.q', b='x.q')}) * sqrt({_DOT.format(a='y.q', b='y.q')}))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION similar_to(a STRING, b STRING) RETURNS TABLE (similarity DOUBLE)
      RETURN SELECT if(s.shared > 0, s.shared, {cosine}) FROM ({va}) x CROSS JOIN ({vb}) y
        CROSS JOIN (SELECT max(least(l.score, r.score)) AS shared FROM ({a}) l JOIN ({b}) r ON l.layer = r.layer AND l.feature = r.feature) s""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION distance_of(similarity DOUBLE) RETURNS DOUBLE
      RETURN CASE WHEN similarity <= 0 THEN 1.7976931348623157e308 ELSE 1 / (1 + similarity) END""")
