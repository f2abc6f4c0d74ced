"""Versioned changes to a feature store: patch tables, overlays, and nearest-neighbour overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import cosine, dot, l2_normalize
from quillon.operators.models import ridge
from quillon.operators.ordering import numbered
from quillon.operators.products import best

PATCH_SCHEMA = (
    "patch_no int, op_no int, op string, layer int, feature long, target string, token_id long, "
    "confidence double, gate array<double>, entity string, relation string"
)


def overlay(features: DataFrame, ops: DataFrame) -> DataFrame:
    """Features after all patches: of each feature the last gate, the last label and whether it was deleted last.

    An insert without a confidence has 0.9; a delete drops label and gate. Features that only patches know are added.
    """
    o = ops.where(F.col("op").isin("insert", "update", "delete")).withColumn("at", F.struct("patch_no", "op_no"))
    meta = F.struct(F.col("target").alias("token"), F.coalesce("token_id", F.lit(0)).alias("token_id"), F.coalesce("confidence", F.when(F.col("op") == "insert", 0.9)).alias("c_score"), (F.col("op") == "delete").alias("deleted"))
    says = F.col("target").isNotNull() | (F.col("op") == "delete")
    last = o.groupBy("layer", "feature").agg(
        F.max_by(F.when(says, meta), F.when(says, F.col("at"))).alias("m"),
        F.max_by(F.when(F.col("op") == "delete", F.lit(None)).otherwise(F.col("gate")), F.when(F.col("gate").isNotNull() | (F.col("op") == "delete"), F.col("at"))).alias("g"),
    )
    both = features.join(last, ["layer", "feature"], "full")
    told, gone = F.col("m").isNotNull(), F.coalesce(F.col("m.deleted"), F.lit(False))
    return both.select(
        "layer", "feature",
        F.when(gone & F.col("g").isNull(), F.lit(None)).otherwise(F.coalesce("g", "gate")).alias("gate"),
        F.when(told, F.when(~gone, F.col("m.token_id"))).otherwise(F.col("token_id")).alias("token_id"),
        F.when(told, F.when(~gone, F.col("m.token"))).otherwise(F.col("token")).alias("token"),
        F.when(told, F.when(~gone, F.coalesce("m.c_score", "c_score"))).otherwise(F.col("c_score")).alias("c_score"),
        F.when(told, F.array().cast("array<struct<token:string,token_id:bigint,logit:double>>")).otherwise(F.col("top_k")).alias("top_k"),
    )


def without_patch(ops: DataFrame, patch_no: int) -> DataFrame:
    return ops.where(F.col("patch_no") != patch_no)


def patch_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("patch_no").agg(
        F.count_if(F.col("op").isin("insert", "insert_knn")).alias("inserts"), F.count_if(F.col("op") == "update").alias("updates"),
        F.count_if(F.col("op").isin("delete", "delete_knn")).alias("deletes"))


def free_feature(features: DataFrame) -> DataFrame:
    """Per layer the lowest feature without a label, else that of the lowest score, the first of equals."""
    return features.groupBy("layer").agg(
        F.coalesce(F.min(F.when(F.col("token").isNull(), F.col("feature"))), F.min_by("feature", F.struct("c_score", "feature"))).alias("feature"))


def find_features(features: DataFrame, entity: str | None = None, layer: int | None = None, relation: str | None = None) -> DataFrame:
    """Labelled features whose label or any further token contains ``entity``, and whose relation (if there is that column) ``relation``, however cased."""
    rows = features.where("token is not null")
    if entity is not None:
        rows = rows.where(F.contains(F.lower("token"), F.lit(entity.lower())) | F.exists("top_k", lambda t: F.contains(F.lower(t["token"]), F.lit(entity.lower()))))
    if relation is not None:
        rows = rows.where(F.contains(F.lower("relation"), F.lit(relation.lower())) if "relation" in rows.columns else F.lit(False))
    return rows if layer is None else rows.where(F.col("layer") == layer)


def op_key(ops: DataFrame) -> DataFrame:
    """``ops`` with ``key``, the ``layer`` and ``feature`` that an operation is about; null for those on nearest-neighbour entries."""
    return ops.withColumn("key", F.when(~F.col("op").isin("insert_knn", "delete_knn"), F.struct("layer", "feature")))


def overlay_walk(queries: DataFrame, view: DataFrame, top: int, layers: list[int] | None = None) -> DataFrame:
    """Best features of a patched view per query (``id, q``) and layer, without those that have no label."""
    view = view if layers is None else view.where(F.col("layer").isin(layers))
    order = [F.col("feature")]
    hits = best(queries.select("id", "q"), view.where("gate is not null"), top, order, left_vector="q", right_vector="gate", key=["id"], per="layer", magnitude=True)
    return hits.where("token is not null")


def entries_of(entries: DataFrame, entity: str) -> DataFrame:
    """Nearest-neighbour entries of an entity, however cased, by layer."""
    return entries.where(F.lower("entity") == entity.lower()).orderBy("layer", "patch_no", "op_no")


def entry_counts(entries: DataFrame) -> DataFrame:
    """``layer, entries`` of the layers that have any."""
    return entries.groupBy("layer").agg(F.count("*").alias("entries"))


def facts_of(cycles: DataFrame, asked: DataFrame) -> DataFrame:
    """The facts (``cycle, pos, entity, relation, ...``) that each request ``id, entity, relation`` is about, however cased; a null relation asks for all."""
    a = asked.select("id", F.lower("entity").alias("e"), F.lower("relation").alias("r"))
    rows = cycles.join(a, (F.lower("entity") == F.col("e")) & (F.col("r").isNull() | (F.lower("relation") == F.col("r"))))
    return rows.drop("e", "r")


def solved_facts(facts: DataFrame, penalty: float) -> DataFrame:
    """Per fact of rows ``key, fact, k, t``: ``decomposed``, what the weights that carry all keys of a group to their targets make of its key, and its cosine to the target."""
    delta = ridge(facts.select("key", "k", "t"), penalty).withColumnRenamed("key", "of")
    rows = facts.join(delta, F.col("key") == F.col("of")).withColumn("decomposed", F.transform("delta", lambda row: dot(row, F.col("k"))))
    return rows.select("key", "fact", "decomposed", cosine("decomposed", "t").alias("cosine"))


def compact_status(features: DataFrame, ops: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """One row: entries, overrides, layers and facts by tier, the epoch (one a change), and the base's size."""
    change = F.col("op").isin("insert", "update", "delete")
    changes = ops.agg(F.count("*").alias("epoch"))
    tier0 = knn_entries(ops).agg(F.count("*").alias("l0_entries"))
    tier1 = ops.where(change).agg(
        F.count_distinct("layer", "feature").alias("l1_edges"), F.count_distinct(F.when(F.col("gate").isNotNull(), F.col("layer"))).alias("l1_layers_used"))
    base = features.agg(F.count_distinct("layer").alias("base_layers"), F.count_if(F.col("layer") == 0).alias("base_features"), F.max(F.size("gate")).alias("hidden_dim"))
    facts = base.select(F.lit(0).cast("long").alias("l2_facts"), F.lit(0).cast("long").alias("l2_cycles")) if cycles is None else cycles.agg(F.count("*").alias("l2_facts"), F.count_distinct("cycle").alias("l2_cycles"))
    return changes.crossJoin(tier0).crossJoin(tier1).crossJoin(facts).crossJoin(base).withColumn("memit_supported", F.col("hidden_dim") >= 1024)  # one row each


def epochs(ops: DataFrame, minor: int, major: int) -> DataFrame:
    """Changes by number: ``epoch, since_minor, since_major``, with both counters set back after so many changes.

    A change's number is its place in the order of patches; numbered by ranges, so that no task sorts all of them.
    """
    rows = numbered(ops.select("patch_no", "op_no", "op"), [F.col("patch_no"), F.col("op_no")], "epoch").withColumn("epoch", F.col("epoch") + 1)
    return rows.withColumns({"since_minor": (F.col("epoch") - 1) % minor + 1, "since_major": (F.col("epoch") - 1) % major + 1})


def knn_entries(ops: DataFrame) -> DataFrame:
    """Nearest-neighbour entries that stand after all patches: inserted, and not deleted by entity later."""
    ins = ops.where("op = 'insert_knn'").select("patch_no", "op_no", "layer", F.col("entity"), "relation", "target", "confidence", l2_normalize("gate").alias("key"))
    gone = ops.where("op = 'delete_knn'").select(F.struct("patch_no", "op_no").alias("at"), F.lower("entity").alias("e"), F.lower("relation").alias("r"))
    later = (F.lower(ins.entity) == gone.e) & (gone.r.isNull() | (F.lower(ins.relation) == gone.r)) & (gone["at"] > F.struct(ins.patch_no, ins.op_no))
    return ins.join(gone, later, "left_anti")


def knn_query(entries: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """Per query (``id, layer, q``) the ``k`` entries of its layer of the largest cosine."""
    q = queries.select("id", "layer", l2_normalize("q").alias("q"))
    found = best(q, entries, k, [F.col("patch_no"), F.col("op_no")], left_vector="q", right_vector="key", key=["id", "layer"], within="layer")
    return found.withColumnRenamed("score", "cosine")


def knn_override(raw: DataFrame, hits: DataFrame, k: int, least: float = 0.75) -> DataFrame:
    """Predictions ``id, rank, token, probability`` whose first is replaced by the first layer's entry over ``least``."""
    best = hits.where((F.col("rank") == 1) & (F.col("cosine") > least)).groupBy("id").agg(F.min_by("target", "layer").alias("token"))
    top = best.select("id", F.lit(1).alias("rank"), "token", F.lit(1.0).alias("probability"))
    kept = raw.join(best.select("id", F.lit(1).alias("moved")), "id", "left").withColumn("rank", F.col("rank") + F.coalesce("moved", F.lit(0))).drop("moved")
    return top.unionByName(kept.select("id", "rank", "token", "probability")).where(F.col("rank") <= k)
