"""Reading feature stores, vectors, labels and patches; writing baked stores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.patches import PATCH_SCHEMA, find_features, free_feature, overlay
from quillon.staging import staged

VECTOR = "_header boolean, id string, layer int, feature bigint, vector array<float>, dim int, top_token string, top_token_id bigint, c_score double, top_k array<struct<token:string,token_id:bigint,logit:double>>"
PATCH = (
    "version int, base_model string, operations array<struct<op:string,layer:int,feature:bigint,entity:string,relation:string,target:string,"
    "confidence:double,gate_vector_b64:string,down_meta:struct<top_token:string,top_token_id:bigint,c_score:double>>>"
)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of line-wise JSON without the header lines, as features."""
    rows = spark.read.schema(VECTOR).json(path).where("_header is null and vector is not null")
    return rows.select("layer", "feature", F.transform("vector", lambda x: x.cast("double")).alias("gate"), F.col("top_token_id").alias("token_id"), F.col("top_token").alias("token"), "c_score", "top_k")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``layer, feature, label`` from line-wise JSON of short or long names."""
    rows = spark.read.schema("_header boolean, l int, f bigint, t string, layer int, feature bigint, label string").json(path).where("_header is null")
    return rows.select(F.coalesce("layer", "l").alias("layer"), F.coalesce("feature", "f").alias("feature"), F.coalesce("label", "t").alias("label")).where("layer is not null and feature is not null")


def f32_vector(text: str) -> F.Column:
    """Doubles from the base64 of little-endian 32-bit floats, by arithmetic on the bits."""
    bytes_ = F.hex(F.unbase64(text))
    words = F.transform(F.sequence(F.lit(0), (F.length(bytes_) / 8 - 1).cast("int")), lambda i: F.substring(bytes_, i * 8 + 1, F.lit(8)))
    order = lambda w: F.conv(F.concat(F.substring(w, 7, 2), F.substring(w, 5, 2), F.substring(w, 3, 2), F.substring(w, 1, 2)), 16, 10).cast("long")
    sign = lambda b: F.when(F.shiftright(b, 31) == 1, -1.0).otherwise(1.0)
    power = lambda b: F.shiftright(b, 23).bitwiseAND(F.lit(255).cast("long"))
    part = lambda b: b.bitwiseAND(F.lit((1 << 23) - 1).cast("long"))
    value = lambda b: F.when(power(b) == 0, part(b) * F.pow(F.lit(2.0), F.lit(-149.0))).otherwise((part(b) + (1 << 23)) * F.pow(F.lit(2.0), (power(b) - 150).cast("double")))
    return F.transform(words, lambda w: sign(order(w)) * value(order(w)))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch files as one table of operations, numbered by file name and position."""
    docs = spark.read.schema(PATCH).option("multiLine", True).json(path).select("*", F.input_file_name().alias("file"))
    numbers = docs.select("file").distinct().selectExpr("file", "cast(row_number() over (order by file) as int) as patch_no")  # one row a file
    ops = docs.join(F.broadcast(numbers), "file").select("patch_no", F.posexplode("operations").alias("op_no", "o"))
    gate = F.when(F.col("o.gate_vector_b64").isNotNull(), f32_vector("o.gate_vector_b64"))
    return ops.select(
        "patch_no", "op_no", "o.op", "o.layer", "o.feature", F.coalesce("o.down_meta.top_token", "o.target").alias("target"), F.col("o.down_meta.top_token_id").alias("token_id"),
        F.coalesce("o.down_meta.c_score", "o.confidence").alias("confidence"), gate.alias("gate"), "o.entity", "o.relation")


def bake(features: DataFrame, path: str) -> None:
    """Write a patched view as a store of its own, a folder a layer."""
    features.write.partitionBy("layer").parquet(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^.*/", "").alias("file"), F.sha2("content", 256).alias("sha256"))


def build_plan(text: str) -> list[tuple[str, list[str]]]:
    """The instructions of a build file, in order: FROM, PATCH, INSERT, DELETE, LABELS, EXPOSE, STAGE; FROM is needed."""
    out = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        word, _, rest = line.partition(" ")
        if word not in ("FROM", "PATCH", "INSERT", "DELETE", "LABELS", "EXPOSE", "STAGE"):
            raise ValueError(f"unknown instruction {word}")
        out.append((word, re.findall(r'"([^"]*)"', rest) if '"' in rest else rest.split()))
    if not any(w == "FROM" for w, _ in out):
        raise ValueError("FROM is missing")
    return out


def build(spark: SparkSession, text: str, stage: str | None = None, folder: str = "") -> tuple[DataFrame, DataFrame]:
    """Carry out a build file: the features it makes, and ``position, instruction, changed``, what each instruction changed.

    FROM names a store of features in Parquet. An INSERT takes a free feature of the middle layer, a DELETE all base
    features whose label or further token contains its last name. Of stages, the one asked for follows the shared part.
    """
    plan, taken, of = build_plan(text), [], None
    for word, names in plan:
        if word == "STAGE":
            of = names[0]
        elif of is None or of == stage:
            taken.append((word, names))
    if stage is not None and not any(w == "STAGE" and n[0] == stage for w, n in plan):
        raise ValueError(f"no stage {stage}")
    at = lambda name: name if name.startswith("/") or "://" in name or not folder else f"{folder.rstrip('/')}/{name}"
    base = spark.read.parquet(at(next(n[0] for w, n in taken if w == "FROM")))
    layers = (base.agg(F.max("layer")).first()[0] or 0) + 1
    ops, history = spark.createDataFrame([], PATCH_SCHEMA), []
    for i, (word, names) in enumerate(taken):
        new = None
        if word == "PATCH":
            new = read_patches(spark, at(names[0])).withColumn("patch_no", F.lit(i))
        elif word == "INSERT":
            free = free_feature(overlay(base, ops).where(F.col("layer") == layers // 2)).first()
            new = spark.createDataFrame([(i, 0, "insert", layers // 2, free["feature"] if free else 0, names[2], 0, 0.9, None, names[0], names[1])], PATCH_SCHEMA)
        elif word == "DELETE":
            new = find_features(base, names[-1]).select(
                F.lit(i).alias("patch_no"), F.lit(0).alias("op_no"), F.lit("delete").alias("op"), "layer", "feature", *[F.lit(None).cast(t).alias(n) for n, t in (("target", "string"), ("token_id", "long"), ("confidence", "double"), ("gate", "array<double>"), ("entity", "string"), ("relation", "string"))])
        if new is not None:
            new = staged(new.select(*ops.columns), "build-ops")
            ops = ops.unionByName(new)
        history.append((i, " ".join([word, *names]), 0 if new is None else new.count()))
    return overlay(base, ops), spark.createDataFrame(history, "position int, instruction string, changed long")
