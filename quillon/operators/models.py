"""The registry of models, expert routing, approximate search, and linear algebra by group."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import norm
from quillon.operators.products import best as best_of
from quillon.staging import staged

REGISTRY = (
    "model_name string, path string, source string, extract_level string, backend string, num_layers int, hidden_size int, "
    "vocab_size int, server_url string, registered_at timestamp"
)
LEVELS = ("browse", "attention", "inference", "all")


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def register(registry: DataFrame, row: dict) -> DataFrame:
    """The registry with the model of this name replaced or added; its path must be given, its level known."""
    row = {"source": "", "extract_level": "browse", "backend": "local"} | row
    if not row.get("model_name") or not row.get("path") or row["extract_level"] not in LEVELS:
        raise ValueError("a model needs a name, a path and a known extract level")
    names = [f.name for f in registry.schema]
    new = registry.sparkSession.createDataFrame([tuple(row.get(n) for n in names)], registry.schema).withColumn("registered_at", F.coalesce("registered_at", F.current_timestamp()))
    return drop(registry, row["model_name"]).unionByName(new)


def drop(registry: DataFrame, name: str) -> DataFrame:
    """Without the model of this name, if there is one."""
    return registry.where(F.col("model_name") != name)


def models(registry: DataFrame) -> DataFrame:
    return registry.drop("backend", "server_url").orderBy("registered_at", "model_name")


def allows(level: str, needed: str) -> bool:
    """Whether an extract level includes another."""
    return LEVELS.index(level) >= LEVELS.index(needed)


def route(queries: DataFrame, router: DataFrame, k: int, over_all: bool = False) -> DataFrame:
    """Per query (``id, x``) and layer the ``k`` experts of the largest score ``w·x + bias`` with their probabilities.

    The softmax runs over the chosen experts; with ``over_all`` over all of them first, scaled by ``scale``
    and made to sum to 1 over the chosen again before that.
    """
    x = queries.select("id", F.concat("x", F.array(F.lit(1.0))).alias("x"))  # the bias is one more product
    experts = router.select("layer", "expert", "scale", F.concat("w", F.array(F.col("bias").cast("double"))).alias("w"))
    chosen = best_of(x, experts, k, ["expert"], left_vector="x", right_vector="w", key=["id"], per="layer")
    per = Window.partitionBy("id", "layer")
    e = F.exp(F.col("score") - F.max("score").over(per))
    p = e / F.sum(e).over(per)  # among the chosen, over all or not: the sum over all cancels out
    return chosen.withColumn("probability", p * F.col("scale") if over_all else p).select("id", "layer", "expert", "rank", "score", "probability")


def routed_totals(routed: DataFrame) -> DataFrame:
    """Per query and expert over all layers: how often it is chosen and its mean probability."""
    return routed.groupBy("id", "expert").agg(F.count("*").alias("times"), F.avg("probability").alias("mean_probability"))


def coded(vectors: np.ndarray) -> np.ndarray:
    """The rows of a matrix as their 8-bit codes give them back: :func:`sq8`, then :func:`sq8_decoded`, step by step the same."""
    lo, hi = vectors.min(1, keepdims=True), vectors.max(1, keepdims=True)
    steps = (vectors - lo) * 255 / np.where(hi > lo, hi - lo, 1.0)
    codes = np.floor(steps)
    codes += steps - codes >= 0.5
    return lo + np.where(hi > lo, np.clip(codes, 0, 255), 0) * (hi - lo) / 255


def approximate_knn(queries: DataFrame, features: DataFrame, k: int, oversample: int = 4) -> DataFrame:
    """As the exact search, but found by 8-bit codes: the best ``k * oversample`` by decoded codes are scored exactly.

    A task makes the codes of the features that reach it, each once, finds by them alone, and scores what it found by the vectors beside
    them, so no candidate takes a vector along. Every feature has a code. Recall is a matter of the
    codes alone (half a step in 255) and is measured against the exact search by the query of this operator.
    """
    near = best_of(queries.select("id", "q"), features.select("layer", "feature", "gate"), k * oversample, ["feature"], left_vector="q", right_vector="gate", key=["id"], per="layer", magnitude=True, codes=coded)
    order = Window.partitionBy("id", "layer").orderBy(F.abs("score").desc(), "feature")
    scored = near.select("id", "layer", "feature", F.col("exact").alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``id, exact, recall``: the share of each query's exact hits (``id, layer, feature``) that were found."""
    hits = exact.select("id", "layer", "feature").join(found.select("id", "layer", "feature").distinct().withColumn("hit", F.lit(1)), ["id", "layer", "feature"], "left")
    return hits.groupBy("id").agg(F.count("*").alias("exact"), (F.count("hit") / F.count("*")).alias("recall"))


def classify(vectors: DataFrame, mean: np.ndarray, components: np.ndarray, coefficients: np.ndarray, intercept: np.ndarray, classes: list[str]) -> DataFrame:
    """``id, route``: principal components, then logistic scores; the first class of the largest. Vectors of another width are unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, "unknown", dtype=object)
            fits = np.flatnonzero(pc.equal(pc.list_value_length(batch.column(1)), len(mean)).fill_null(False).to_numpy(zero_copy_only=False))
            if len(fits):
                v = batch.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), -1)
                out[fits] = np.array(classes, dtype=object)[((v - mean) @ components.T @ coefficients.T + intercept).argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "route"])

    return vectors.select("id", F.col("v").cast("array<double>")).mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, route string")


def _outer_sums(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``key, at, x``: the sum over each key's rows of the outer products of two columns, added up in each task first."""
    outer = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))
    return rows.select("key", F.posexplode(outer).alias("at", "x")).groupBy("key", "at").agg(F.sum("x").alias("x"))


def ridge(groups: DataFrame, penalty: float) -> DataFrame:
    """``key, delta`` of groups of rows ``key, k, t``: the weights that carry keys to targets, ``TᵀK(KᵀK + λI)⁻¹``.

    Only sums of outer products, of the vectors' widths, reach the task of a group, which may be of any size.
    """
    sums = _outer_sums(groups, "k", "k").withColumn("of", F.lit("k")).unionByName(_outer_sums(groups, "t", "k").withColumn("of", F.lit("t")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, cross = (g.sort_values("at")["x"].to_numpy() for _, g in sorted(pdf.groupby("of")))
        width = int(round(len(gram) ** 0.5))
        inner = gram.reshape(width, width) + penalty * np.eye(width)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "delta": [np.linalg.solve(inner, cross.reshape(-1, width).T).T.tolist()]})

    return sums.groupBy("key").applyInPandas(solve, "key string, delta array<array<double>>")


def singular_vectors(rows: DataFrame, k: int, rounds: int = 4, seed: int = 42) -> DataFrame:
    """``key, i, value, v`` of groups of rows ``key, v``: the ``k`` right singular vectors of the largest values.

    Each task adds up its rows' share of the Gram matrix (of the vectors' width), so a group may be of any size.
    """
    sums = _outer_sums(rows, "v", "v")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = pdf.sort_values("at")["x"].to_numpy()
        width = int(round(len(gram) ** 0.5))
        values, vectors = np.linalg.eigh(gram.reshape(width, width))
        top = np.argsort(-values)[:k]
        signed = [vectors[:, i] * (1 if vectors[np.abs(vectors[:, i]).argmax(), i] >= 0 else -1) for i in top]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "i": range(len(top)), "value": np.sqrt(np.maximum(values[top], 0)), "v": [s.tolist() for s in signed]})

    return sums.groupBy("key").applyInPandas(solve, "key string, i int, value double, v array<double>")


def refined_gates(facts: DataFrame, decoys: DataFrame) -> DataFrame:
    """``layer, feature, gate, retained``: gates made orthogonal to the other facts' gates and decoys of their layer.

    A layer's decoys enter by their span: an orthonormal basis of it, from the sum of their outer products, has no more
    vectors than a gate has entries. Facts of a layer are the edits that one rewrite makes; they are one group.
    """
    sums = _outer_sums(decoys.select(F.col("layer").alias("key"), "v"), "v", "v")

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = pdf.sort_values("at")["x"].to_numpy()
        width = int(round(len(gram) ** 0.5))
        values, vectors = np.linalg.eigh(gram.reshape(width, width))
        kept = vectors[:, values > 1e-12 * max(values.max(), 1e-12)]
        return pd.DataFrame({"layer": [int(pdf["key"].iloc[0])], "basis": [kept.T.tolist()]})

    spans = sums.groupBy("key").applyInPandas(span, "layer int, basis array<array<double>>")
    rows = facts.select("layer", "feature", "gate").join(spans, "layer", "left")

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        gates = np.stack(pdf["gate"].to_numpy())
        first = pdf["basis"].iloc[0]
        decoy = np.zeros((0, gates.shape[1])) if first is None else np.stack(list(first))
        free = gates - gates @ decoy.T @ decoy
        out = []
        for i in range(len(gates)):
            others = np.delete(free, i, axis=0)
            _, values, vectors = np.linalg.svd(others, full_matrices=False)
            basis = vectors[values > 1e-6]
            g = free[i] - free[i] @ basis.T @ basis
            out.append((int(pdf["layer"].iloc[0]), int(pdf["feature"].iloc[i]), g.tolist(), float(np.linalg.norm(g) / max(np.linalg.norm(gates[i]), 1e-12))))
        return pd.DataFrame(out, columns=["layer", "feature", "gate", "retained"])

    return rows.groupBy("layer").applyInPandas(refine, "layer int, feature long, gate array<double>, retained double")


def whole_words(tokens: DataFrame) -> DataFrame:
    """Tokens that are words: three bytes at least, of letters, digits, apostrophes and hyphens."""
    return tokens.where((F.octet_length(F.trim("token")) >= 3) & F.trim("token").rlike("^[A-Za-z0-9'-]+$"))


def gate_tokens(features: DataFrame, tokens: DataFrame) -> DataFrame:
    """``layer, feature, token_id, score``: the word that activates each feature most."""
    words = whole_words(tokens).select("token_id", "embedding")
    found = best_of(features.select("layer", "feature", "gate"), words, 1, ["token_id"], left_vector="gate", right_vector="embedding", key=["layer", "feature"])
    return found.select("layer", "feature", "token_id", "score")


def offset_directions(features: DataFrame, ins: DataFrame, tokens: DataFrame) -> DataFrame:
    """``layer, feature, direction``: from the word that activates a feature to its label, of norm 1; null for ids up to 2 and equal ends."""
    e = lambda name: tokens.select(F.col("token_id").alias(name), F.col("embedding").alias(f"e_{name}"))
    both = features.select("layer", "feature", F.col("token_id").alias("out")).join(ins.select("layer", "feature", F.col("token_id").alias("inp")), ["layer", "feature"]).join(e("out"), "out").join(e("inp"), "inp")
    d = both.withColumn("d", F.zip_with("e_out", "e_inp", lambda x, y: x - y)).withColumn("size", norm("d"))
    return d.select("layer", "feature", F.when((F.col("out") > 2) & (F.col("size") > 1e-12), F.transform("d", lambda x: x / F.col("size"))).alias("direction"))


def token_gate_index(features: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """Per token the ``k`` features of the largest absolute ``silu(gate·e)``, ready to be looked up."""
    order = ["layer", "feature"]
    found = best_of(
        tokens.select("token_id", "embedding"), features.select("layer", "feature", "gate"), k, order,
        left_vector="embedding", right_vector="gate", key=["token_id"], magnitude=True, score=lambda x: x / (1 + np.exp(-x)), shrinks=True)
    return found.select("layer", "feature", "token_id", F.col("score").alias("act"), "rank")


def looked_up(index: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Features of the wanted tokens (``id, token_id``), each with its largest activation, the best ``k`` a request."""
    best = index.join(wanted, "token_id").groupBy("id", "layer", "feature").agg(F.max_by("act", F.struct(F.abs("act"), "act")).alias("act"))
    order = Window.partitionBy("id").orderBy(F.abs("act").desc(), "layer", "feature")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def walk_residuals(residuals: DataFrame, features: DataFrame, top: int = 20) -> DataFrame:
    """Hits of each layer's own residual (``id, layer, q``) in that layer, labelled ones only."""
    hits = best_of(
        residuals.select("id", "layer", "q"), features.select("layer", "feature", "token", "gate"), top, [F.col("feature")],
        left_vector="q", right_vector="gate", key=["id", "layer"], within="layer", magnitude=True)
    return hits.where("token is not null").select("id", "layer", "rank", "feature", "score", "token")


def covariance(rows: DataFrame) -> DataFrame:
    """``layer, i, j, value`` of rows ``layer, v``: mean outer products, added up before the exchange."""
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform("v", lambda y, j: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("p")))))
    return rows.select("layer", F.explode(pairs).alias("c")).groupBy("layer", "c.i", "c.j").agg(F.avg("c.p").alias("value"))


def template_universe(hits: DataFrame, least: float) -> DataFrame:
    """Per template and layer all features that any entity activates beyond ``least``."""
    return hits.where(F.abs("score") > least).groupBy("template", "layer").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def op_call(text: str) -> dict | None:
    """The first balanced ``{...}`` of a reply that is JSON with a string ``op``; code fences and full-width marks are seen through."""
    text = text.translate(str.maketrans("｛｝：，“”", '{}:,""'))
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            else:
                depth += (c == "{") - (c == "}")
                if not depth:
                    try:
                        found = json.loads(text[start : end + 1])
                    except ValueError:
                        break
                    if isinstance(found.get("op"), str):
                        return found
                    break
    return None


def detected_templates(prompts: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, template`` whose tokens are the longest prefix of the prompt's, the first by name of equals."""
    t = templates.select("template", F.col("tokens").alias("prefix"), F.size("tokens").alias("n"))
    both = prompts.join(F.broadcast(t), F.slice("tokens", 1, F.greatest("n", F.lit(1))) == F.col("prefix"))
    best = both.groupBy("id").agg(F.max("n").alias("n"))
    return both.join(best, ["id", "n"]).groupBy("id").agg(F.min("template").alias("template"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """A warmed table: written once, read by all that follows."""
    return staged(df, name)
