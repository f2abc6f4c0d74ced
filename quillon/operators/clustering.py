"""Clustering and labelling of features, probing, and statistics of extracted edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import dot, l2_normalize
from quillon.functions.vocabularies import LABEL_STOP_WORDS
from quillon.operators.knowledge import gate_knn
from quillon.operators.products import best as best_of
from quillon.operators.products import cells, dealt, packed, totals
from quillon.staging import staged


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _assigned(centres: np.ndarray):
    """``id, cluster, s`` of the nearest centre, the first of equals."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.round(_matrix(batch, 1) @ centres.T, 12)
                at = s.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(s[np.arange(len(at)), at])], ["id", "cluster", "s"])

    return assign


def _sums(centres: np.ndarray):
    """``cluster, n, total``: of each batch the vectors added up by nearest centre."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _matrix(batch, 1)
                at = np.round(u @ centres.T, 12).argmax(1)
                found, n = np.unique(at, return_counts=True)
                total = [u[at == c].sum(0) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n), pa.array(total, pa.list_(pa.float64()))], ["cluster", "n", "total"])

    return add


def kmeans(vectors: DataFrame, k: int, max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Spherical k-means over ``id, v``: assignments ``id, cluster, distance`` and centres ``cluster, centre``.

    Begins with the vector of the largest norm, then each time with the one farthest from all centres;
    assigns to the centre of the largest inner product, the first of equals; ends when no centre moves or after
    ``max_rounds``. The ``k`` centres go along with the tasks, which add up their vectors before the exchange.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select("id", l2_normalize("v").alias("u"), F.sqrt(dot("v", "v")).alias("size")), "kmeans-rows")
    n = rows.count()
    if not n:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), spark.createDataFrame([], "cluster int, centre array<double>")
    kind = rows.schema["id"].dataType.simpleString()
    assigned = lambda c: rows.select("id", "u").mapInArrow(_assigned(c), f"id {kind}, cluster int, s double")
    centres = np.array([rows.orderBy(F.desc("size"), "id").first()["u"]])
    for _ in range(1, min(k, n)):
        far = assigned(centres).orderBy("s", "id").first()["id"]
        centres = np.vstack([centres, rows.where(F.col("id") == F.lit(far)).first()["u"]])
    for _ in range(max_rounds):
        sums = rows.select("id", "u").mapInArrow(_sums(centres), "cluster int, n long, total array<double>")
        sums = sums.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg((F.sum("x") / F.sum("n")).alias("x")).collect()  # a few numbers a centre
        moved = np.zeros_like(centres)
        for r in sums:
            moved[r["cluster"], r["dim"]] = r["x"]
        size = np.sqrt((moved**2).sum(1, keepdims=True))
        moved = np.where(size >= 1e-12, moved / np.maximum(size, 1e-12), 0.0)
        still = np.abs(moved - centres).max() <= 1e-12
        if still:
            break
        used, centres = centres, moved
    else:  # the last round's assignments are those to the centres before it
        return _result(assigned(used)), _centres(spark, centres)
    return _result(assigned(centres)), _centres(spark, centres)


def _result(assigned: DataFrame) -> DataFrame:
    return assigned.select("id", "cluster", (1 - F.col("s")).alias("distance"))


def _centres(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")


def tfidf_labels(members: DataFrame, top: int = 5) -> DataFrame:
    """``cluster, label, tokens`` from rows ``cluster, feature, text`` (tokens parted by ``|``).

    Stop words and tokens that are short or hardly plain do not count; a cluster without any other is named ``cluster-`` and its number.
    """
    n = members.select("feature").distinct().count()
    words = members.select("cluster", F.explode(F.split(F.lower("text"), r"\|")).alias("w")).withColumn("w", F.trim("w"))
    words = words.where((F.octet_length("w") >= 3) & (2 * F.length(F.regexp_replace("w", "[^A-Za-z0-9]", "")) >= F.length("w")) & ~F.col("w").isin(LABEL_STOP_WORDS))
    tf = words.groupBy("cluster", "w").agg(F.count("*").alias("n"))
    whole = tf.groupBy("cluster").agg(F.sum("n").alias("all"))
    everywhere = tf.groupBy("w").agg(F.sum("n").alias("everywhere"))
    scored = tf.join(whole, "cluster").join(everywhere, "w").withColumn("score", F.col("n") / F.col("all") * F.log(F.lit(float(n)) / F.col("everywhere")))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("score", 9).desc(), F.desc("n"), "w"))).where(F.col("r") <= top)
    out = best.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda e: e["w"]).alias("tokens"))
    out = members.select("cluster").distinct().join(out, "cluster", "left")
    label = F.coalesce(F.array_join(F.slice("tokens", 1, 3), "/"), F.concat(F.lit("cluster-"), F.col("cluster").cast("string")))
    return out.select("cluster", label.alias("label"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def pair_labels(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``cluster, relation, hits`` by the relations that a cluster's ``(in, out)`` pairs are known under; needs two and a tenth."""
    n = pairs.groupBy("cluster").agg(F.count("*").alias("pairs"))
    hits = pairs.join(relations, (F.lower(pairs["in_token"]) == relations.subject_lc) & (F.lower(pairs["out_token"]) == relations.object_lc))
    hits = hits.groupBy("cluster", "relation").agg(F.count("*").alias("hits"))
    best = hits.groupBy("cluster").agg(F.max_by("relation", F.struct("hits", "relation")).alias("relation"), F.max("hits").alias("hits"))
    return best.join(n, "cluster").where(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("pairs") / 10))).select("cluster", "relation", "hits")


def output_labels(outputs: DataFrame, relations: DataFrame) -> DataFrame:
    """As :func:`pair_labels` by outputs alone: at least two hits and twice the runner-up."""
    hits = outputs.join(relations.select("relation", F.col("object_lc").alias("o")).distinct(), F.lower(outputs["out_token"]) == F.col("o")).groupBy("cluster", "relation").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("cluster").orderBy(F.desc("hits"), "relation")
    ranked = hits.withColumn("next", F.lead("hits", 1, 0).over(order)).withColumn("r", F.row_number().over(order))
    return ranked.where((F.col("r") == 1) & (F.col("hits") >= 2) & (F.col("hits") >= 2 * F.col("next"))).select("cluster", "relation", "hits")


def probe(queries: DataFrame, features: DataFrame, first: int = 3, least: float = 5.0) -> DataFrame:
    """``layer, feature, entities``: the entities (``id, q``) among whose best ``first`` hits of a layer a feature is, over ``least``."""
    hits = gate_knn(queries, features, first).where(F.col("score") > least)
    return hits.groupBy("layer", "feature").agg(F.array_sort(F.collect_set("id")).alias("entities"))


def confirmed_pairs(probed: DataFrame, features: DataFrame, most: int = 20) -> DataFrame:
    """Entity and label of features that few entities activate."""
    rows = probed.where(F.size("entities") <= most).join(features.where(F.octet_length("token") >= 2), ["layer", "feature"])
    return rows.select("layer", "feature", F.explode("entities").alias("entity"), "token")


def classify_direction(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``id, cluster, cosine`` of the nearest centre; zero vectors are in cluster 0 with 0."""
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(dot(c, c)))
    long = lambda c: F.sqrt(dot(c, c)) >= 1e-8
    v = vectors.where(long("v")).select("id", unit("v").alias("u"))
    c = centres.where(long("centre")).select("cluster", unit("centre").alias("c"))
    found = best_of(v, c, 1, ["cluster"], left_vector="u", right_vector="c", key=["id"]).select(F.col("id").alias("found_id"), "cluster", "score")
    every = vectors.join(found, F.col("id") == F.col("found_id"), "left")
    return every.select("id", F.coalesce("cluster", F.lit(0)).alias("cluster"), F.coalesce("score", F.lit(0.0)).alias("cosine"))


def layer_stats(edges: DataFrame) -> DataFrame:
    """Per layer of edges ``layer, subject, object, c_in, c_out, confidence, selectivity``: means, extremes, loops, counts over thresholds."""
    cuts = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90)
    over = [F.count_if(F.col(c) >= t).alias(f"{c}_ge_{int(t * 100):02d}") for c in ("confidence", "selectivity") for t in cuts]
    loops = F.count_if(F.col("subject") == F.col("object"))
    return edges.groupBy("layer").agg(
        F.count("*").alias("edges"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.min("confidence").alias("min_confidence"),
        F.avg("selectivity").alias("mean_selectivity"), F.avg("c_in").alias("mean_c_in"), F.avg("c_out").alias("mean_c_out"), loops.alias("self_loops"), (loops * 100.0 / F.count("*")).alias("self_loop_pct"), *over)


def _longest(ov: np.ndarray, held: list, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of all blocks the ``kept`` that ``ov`` makes longest, and their equals: block, row, length and what is made of each, by block and row.

    Only the directions that the matrix carries are multiplied, in single precision; what that could be wrong by leaves few for the whole matrix.
    """
    _, values, axes = np.linalg.svd(ov, full_matrices=False)
    few = values > 1e-9 * values[0]
    norm, axes = float(np.sqrt((values**2).sum())), (values[:, None] * axes)[few].T
    bound, found, fresh = -np.inf, [], 0
    for b, other in enumerate(held):
        short = norm * other.most < 1e15
        size = np.sqrt((((other.short if short else other.vectors) @ axes.astype(np.float32 if short else float)) ** 2).sum(1))
        wrong = ((ov.shape[1] + len(values) + 16) * 2.0**-24 + 1e-8) * norm * other.most + 2e-9
        at = np.flatnonzero(size >= bound - wrong)
        out = other.vectors[at].astype(float) @ ov.T
        size = np.round(np.sqrt((out**2).sum(1)), 9)
        still = size >= bound
        found.append((np.full(int(still.sum()), b), at[still], size[still], out[still]))
        fresh += len(found[-1][0])
        if fresh > 4 * kept or b == len(held) - 1:
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            if len(columns[2]) > kept:
                bound = np.partition(columns[2], -kept)[-kept]
            found = [tuple(c[columns[2] >= bound] for c in columns)]
            fresh = 0
    return found[0]


def attention_walk(heads: DataFrame, tokens: DataFrame, k: int = 5, least: float = 0.02, wide: int = 10) -> DataFrame:
    """Edges input token → output token of each attention head (``layer, head, ov``, a matrix of rows), normalised per layer.

    Inputs are the ``wide * k`` tokens whose embedding the head makes longest (``c_in``), outputs the ``k`` tokens nearest
    to what it makes of them (``c_out``), from ``least`` on. Heads meet tokens in blocks.
    """
    kept = wide * k
    flat = heads.select(F.col("layer").cast("int").alias("layer"), F.col("head").cast("int").alias("head"), F.flatten("ov").alias("flat_ov"))
    rows, _ = dealt(packed(flat, "flat_ov"), packed(tokens.select("token_id", "token", "embedding"), "embedding"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in cells(batches):
            for i, ov in enumerate(block.vectors.astype(float)):
                which, at, size, out = _longest(ov.reshape(-1, held[0].vectors.shape[1]), held, kept)
                rest = pa.concat_arrays([held[b].rest.take(pa.array(at[which == b])) for b in np.unique(which)])
                head = block.rest.take(pa.array(np.full(len(rest), i)))
                columns = [*head.flatten(), *rest.flatten(), pa.array(size), pa.array(list(out), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["layer", "head", "token_id", "subject", "c_in", "made"])

    schema = "layer int, head int, token_id long, subject string, c_in double, made array<double>"
    order = Window.partitionBy("layer", "head").orderBy(F.desc("c_in"), "token_id")
    ins = staged(rows.mapInArrow(made, schema), "attention-inputs").withColumn("r", F.row_number().over(order)).where(F.col("r") <= kept).drop("r")
    key = ["layer", "head", "token_id"]
    outs = best_of(ins, tokens.select(F.col("token_id").alias("out_id"), F.col("token").alias("object"), "embedding"), k, ["out_id"], left_vector="made", right_vector="embedding", key=key, least=least)
    edges = staged(outs.select("layer", "head", "subject", "object", "c_in", F.col("score").alias("c_out")), "attention-edges")
    raw = F.col("c_in") * F.col("c_out")
    most = edges.groupBy("layer").agg(F.max(raw).alias("most"), F.max("c_in").alias("most_in"))
    return edges.join(most, "layer").select(
        *edges.columns, F.concat(F.lit("L"), "layer", F.lit("-H"), "head").alias("relation"), (raw / F.col("most")).alias("confidence"), (F.col("c_in") / F.col("most_in")).alias("selectivity"))


def top_entities(edges: DataFrame, top: int = 10) -> DataFrame:
    """``layer, side, entity, n, mean_confidence, rank``: the most frequent subjects and objects of each layer, the surer of equals."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("entity")) for s in ("subject", "object")])
    rows = edges.select("layer", F.explode(sides).alias("s"), "confidence").select("layer", "s.*", "confidence")
    rows = rows.groupBy("layer", "side", "entity").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
    order = Window.partitionBy("layer", "side").orderBy(F.desc("n"), F.round("mean_confidence", 9).desc(), "entity")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def weight_walk(features: DataFrame, tokens: DataFrame, k: int = 5, least: float = 0.02) -> DataFrame:
    """Edges input token → output token of each feature: best inputs by gate, best outputs by ``top_k``, normalised per layer."""
    words = tokens.select("token_id", F.col("token").alias("subject"), "embedding")
    ins = best_of(features.select("layer", "feature", "gate"), words, k, ["token_id"], left_vector="gate", right_vector="embedding", key=["layer", "feature"], least=least)
    outs = features.select("layer", "feature", F.explode(F.slice("top_k", 1, k)).alias("o")).where(F.col("o.logit") >= least)
    edges = ins.select("layer", "feature", "subject", F.col("score").alias("c_in")).join(outs, ["layer", "feature"])
    edges = staged(edges.select("layer", "feature", "subject", F.col("o.token").alias("object"), "c_in", F.col("o.logit").alias("c_out")), "walk-edges")
    raw = F.col("c_in") * F.col("c_out")
    most = edges.groupBy("layer").agg(F.max(raw).alias("most"), F.max("c_in").alias("most_in"))  # one row a layer
    names = ["layer", "feature", "subject", "object", "c_in", "c_out"]
    return edges.join(most, "layer").select(
        *names, F.concat(F.lit("L"), "layer", F.lit("-F"), "feature").alias("relation"), (raw / F.col("most")).alias("confidence"), (F.col("c_in") / F.col("most_in")).alias("selectivity"))


def softmax_top(logits: DataFrame, k: int, temperature: float = 1.0, softcap: float | None = None) -> DataFrame:
    """``id, token_id, probability, rank`` from ``id, token_id, logit``: softcap, temperature, softmax over all, the best ``k``."""
    x = F.col("logit") if softcap is None else F.tanh(F.col("logit") / softcap) * softcap
    rows = logits.withColumn("x", x / max(temperature, 1e-6))
    most = rows.groupBy("id").agg(F.max("x").alias("most"))
    sums = rows.join(most, "id").groupBy(F.col("id").alias("of")).agg(F.sum(F.exp(F.col("x") - F.col("most"))).alias("all"), F.first("most").alias("most"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("x"), "token_id"))).where(F.col("rank") <= k)
    return top.join(sums, F.col("id") == F.col("of")).select("id", "token_id", (F.exp(F.col("x") - F.col("most")) / F.col("all")).alias("probability"), "rank")


def predictions(nodes: DataFrame, tokens: DataFrame, k: int, temperature: float = 1.0, softcap: float | None = None) -> DataFrame:
    """As :func:`softmax_top`, of the products of each node (``id, residual``) and all tokens' embeddings, which are never listed."""
    words, t = tokens.select("token_id", "embedding"), max(temperature, 1e-6)

    def shift(s: np.ndarray) -> np.ndarray:
        if softcap is not None:
            np.multiply(np.tanh(np.divide(s, softcap, out=s), out=s), softcap, out=s)
        return np.divide(s, t, out=s)

    top = best_of(nodes, words, k, ["token_id"], left_vector="residual", right_vector="embedding", key=["id"], shift=shift)
    x = F.col("score") if softcap is None else F.tanh(F.col("score") / softcap) * softcap
    return top.select("id", "token_id", F.exp(x / t - F.col("log_sum")).alias("probability"), "rank")


def answer_trajectory(nodes: DataFrame, tokens: DataFrame, answer_id: int) -> DataFrame:
    """``trace_id, layer, rank, probability`` of one token at each node's residual: how the answer comes up layer by layer."""
    words, key = tokens.select("token_id", "embedding"), ["trace_id", "layer"]
    answer = words.where(F.col("token_id") == answer_id)
    own = best_of(nodes.select(*key, F.col("residual").alias("copy"), "residual"), answer, 1, ["token_id"], left_vector="copy", right_vector="embedding", key=key)
    marked = own.select(*key, "residual", F.col("score").alias("mark"))
    sums = totals(marked, words, left_vector="residual", right_vector="embedding", key=[*key, "mark"], above="mark")
    return sums.select(*key, (F.col("n_above") + 1).cast("int").alias("rank"), F.exp(F.col("mark") - F.col("log_sum")).alias("probability"))


def layer_summaries(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``trace_id, layer, token_id, probability, norm``: what each node (``trace_id, layer, residual``) would say, and the residual's length."""
    rows = nodes.select(F.struct("trace_id", "layer").alias("id"), "residual")
    first = predictions(rows, tokens, 1).select("id", "token_id", "probability")
    return first.join(rows.select("id", F.sqrt(dot("residual", "residual")).alias("norm")), "id").select("id.trace_id", "id.layer", "token_id", "probability", "norm")
