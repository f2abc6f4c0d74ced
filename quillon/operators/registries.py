"""Relations, type rules and prompt templates as tables, and what a provider of predictions answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.staging import staged

TEMPLATE = "relation string, template string, reverse_template string, multi_token boolean, stop_tokens array<string>"
RELATION = "name string, subject_types array<string>, object_types array<string>, reversible boolean"
RULE = "node_type string, outgoing array<string>, incoming array<string>"


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of a key the last by ``pos``."""
    names = [c for c in rows.columns if c != "pos"]
    return rows.groupBy(F.col(key).alias("of")).agg(F.max_by(F.struct(*names), "pos").alias("r")).select("r.*")


def templates_of_json(spark: SparkSession, path: str) -> DataFrame:
    """Templates from a JSON list; entries without a relation or a template are passed over, of a relation the last counts."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{TEMPLATE.replace(' ', ':').replace(',:', ',')}>>")).alias("pos", "t"))
    return _last(text.select("pos", "t.*").where("relation is not null and template is not null"), "relation")


def register_template(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the new templates, which replace those of their relations."""
    return registry.join(new.select("relation"), "relation", "left_anti").select(registry.columns).unionByName(new, allowMissingColumns=True)


def schema_of_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Relations (of a name the last counts) and type rules (``rule_no``, in order) of a schema's JSON; entries without a name are passed over."""
    kind = lambda schema: f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"relations {kind(RELATION)}, type_rules {kind(RULE)}").alias("s"))
    relations = _last(text.select(F.posexplode("s.relations").alias("pos", "r")).select("pos", "r.*").where("name is not null"), "name")
    rules = text.select(F.posexplode("s.type_rules").alias("rule_no", "r")).select("rule_no", "r.*").where("node_type is not null")
    empty = F.array().cast("array<string>")
    return relations, rules.withColumns({c: F.coalesce(c, empty) for c in ("outgoing", "incoming")})


def to_json(rows: DataFrame, path: str) -> None:
    """Write a registry as line-wise JSON."""
    rows.write.json(path)


def top(predictions: Column | str) -> Column:
    """The first prediction of an array, null of an empty one."""
    return F.get(predictions, F.lit(0))


def top_token(predictions: Column | str) -> Column:
    return top(predictions)["token"]


def top_probability(predictions: Column | str) -> Column:
    """The first prediction's probability, 0 where there is none."""
    return F.coalesce(top(predictions)["probability"], F.lit(0.0))


def mock_answers(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` with ``predictions``: the first word of what is known (``suffix, answer, probability``) for the longest suffix of the prompt.

    The lengths of the known suffixes are few, so a prompt gives one suffix a length and meets the known ones by equality.
    """
    suffix = F.trim("suffix")
    sizes = known.select(F.length(suffix).alias("n")).distinct()
    sizes = sizes.agg(F.sort_array(F.collect_list("n")).alias("sizes"))
    k = known.select(suffix.alias("k_suffix"), F.split(F.trim("answer"), r"\s+")[0].alias("word"), "probability")
    rows = staged(asked.withColumn("__row", F.monotonically_increasing_id()), "asked")
    ends = rows.crossJoin(F.broadcast(sizes)).select("__row", F.trim("prompt").alias("p"), F.explode("sizes").alias("n")).where(F.col("n") <= F.length("p"))
    found = ends.join(k, F.right("p", F.col("n")) == F.col("k_suffix")).groupBy("__row").agg(F.max_by(F.struct("word", "probability"), F.struct("n", "word")).alias("b"))
    one = F.array(F.struct(F.concat(F.lit(" "), "b.word").alias("token"), F.lit(-1).alias("token_id"), F.col("b.probability").alias("probability"), F.log("b.probability").alias("logit")))
    none = F.array().cast("array<struct<token:string,token_id:int,probability:double,logit:double>>")
    return rows.join(found, "__row", "left").withColumn("predictions", F.when(F.col("b").isNotNull(), one).otherwise(none)).drop("__row", "b")
