"""Knowledge-graph operators on edge tables ``seq, subject, relation, object, confidence, source``.

``seq`` is any sortable column that gives the order of insertion. Walks and searches advance by whole
frontiers, one join a step; nothing is gathered on the driver but counters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import is_valid_entity
from quillon.operators.components import connected_components
from quillon.staging import staged

TRIPLE = ["subject", "relation", "object"]
#: Edges that a task of a round of ranks sorts, about.
RANK_ROWS = 1_000_000
# Which source wins where two edges state the same.
PRIORITY = {"manual": 5, "wikidata": 4, "parametric": 3, "document": 2, "installed": 1, "unknown": 0}


def priority(source: Column | str) -> Column:
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(F.col(source) == name if isinstance(source, str) else source == name, value).otherwise(out)
    return out


def business_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among customers, suppliers, parts, brands, nations and regions of the tables in ``sf_dir``."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def named(df: DataFrame, s: Column, r: str, o: Column, c: Column, source: str) -> DataFrame:
        return df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"), c.cast("double").alias("confidence"), F.lit(source).alias("source"))

    k = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    # Rounded by floor, which is the same on any engine.
    share = lambda col: F.floor((F.col(col) + 1000) / 11000 * 10000 + 0.5) / 10000
    supplies = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    parts = [
        named(t("nation"), k("N", "n_nationkey"), "in_region", k("R", "n_regionkey"), F.lit(1.0), "manual"),
        named(t("customer"), k("C", "c_custkey"), "in_nation", k("N", "c_nationkey"), share("c_acctbal"), "document"),
        named(t("supplier"), k("S", "s_suppkey"), "in_nation", k("N", "s_nationkey"), share("s_acctbal"), "wikidata"),
        named(supplies, k("S", "l_suppkey"), "supplies", k("P", "l_partkey"), F.round(0.5 + (F.col("n") + F.col("l_partkey") * 7) % 50 / 100, 4), "parametric"),
        named(t("part"), k("P", "p_partkey"), "has_brand", F.col("p_brand"), F.lit(0.8), "installed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seq", F.concat_ws("|", *TRIPLE))


def add_edges(graph: DataFrame, new: DataFrame) -> DataFrame:
    """Both, of equal triples the first by ``seq``; confidences are held to 0..1."""
    every = graph.unionByName(new).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    first = Window.partitionBy(*TRIPLE).orderBy("seq")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def deduplicate(edges: DataFrame, strategy: str = "max_confidence") -> DataFrame:
    """One edge a triple: the most confident, the first of equals; or just the first."""
    order = [F.desc("confidence"), F.col("seq")] if strategy == "max_confidence" else [F.col("seq")]
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy(*TRIPLE).orderBy(*order))).where("__n = 1").drop("__n")


def remove_edges(graph: DataFrame, gone: DataFrame) -> DataFrame:
    return graph.join(gone.select(*TRIPLE).distinct(), TRIPLE, "left_anti").select(graph.columns)


def select(graph: DataFrame, subject: str | None = None, relation: str | None = None, obj: str | None = None) -> DataFrame:
    for name, value in (("subject", subject), ("relation", relation), ("object", obj)):
        if value is not None:
            graph = graph.where(F.col(name) == value)
    return graph


def describe_entity(graph: DataFrame, entity: str) -> DataFrame:
    """Outgoing edges, then incoming ones; a loop is both."""
    out, into = graph.where(F.col("subject") == entity), graph.where(F.col("object") == entity)
    return out.withColumn("direction", F.lit("out")).unionByName(into.withColumn("direction", F.lit("in")))


def exists(graph: DataFrame, triples: DataFrame) -> DataFrame:
    """``triples`` with ``found``."""
    known = graph.select(*TRIPLE).distinct().withColumn("__f", F.lit(True))
    return triples.join(known, TRIPLE, "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__f")


def walk(graph: DataFrame, starts: DataFrame, relations: list[str]) -> DataFrame:
    """``start, path, entity`` for each start that has an edge at each hop: the most confident, the last of equals."""
    at = starts.select("start", F.col("start").alias("entity"), F.array("start").alias("path"))
    for relation in relations:
        hop = graph.where(F.col("relation") == relation).groupBy("subject").agg(F.max_by("object", F.struct("confidence", "seq")).alias("next"))
        at = at.join(hop, at.entity == hop.subject).select("start", F.col("next").alias("entity"), F.concat("path", F.array("next")).alias("path"))
    return at


def walk_all_paths(graph: DataFrame, starts: DataFrame, relations: list[str], most: int = 0) -> DataFrame:
    """``start, entity, path, confidence`` of all paths, by the least confidence on them; ``most`` a start if above 0."""
    at = starts.select("start", F.col("start").alias("entity"), F.array("start").alias("path"), F.lit(1.0).alias("confidence"))
    for relation in relations:
        hop = graph.where(F.col("relation") == relation).select("subject", F.col("object").alias("next"), F.col("confidence").alias("c"))
        at = at.join(hop, at.entity == hop.subject).select(
            "start", F.col("next").alias("entity"), F.concat("path", F.array("next")).alias("path"), F.least("confidence", "c").alias("confidence"))
    if most > 0:
        order = Window.partitionBy("start").orderBy(F.desc("confidence"), "path")
        at = at.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    return at


def search(graph: DataFrame, query: str, n: int = 10) -> DataFrame:
    """Edges by the number of the query's words (repeats count) among the words of their triple; hyphens part words."""
    words = F.split(F.lower(F.lit(query)), r"\s+")
    asked = graph.sparkSession.range(1).select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("times"))
    own = F.split(F.replace(F.lower(F.concat_ws(" ", *TRIPLE)), F.lit("-"), F.lit(" ")), r"\s+")
    tokens = graph.select("seq", F.explode(F.array_distinct(own)).alias("word"))
    scores = tokens.join(F.broadcast(asked), "word").groupBy("seq").agg(F.sum("times").alias("score"))
    return graph.join(scores, "seq").orderBy(F.desc("score"), "seq").limit(n)


def bfs(graph: DataFrame, source: str, max_depth: int) -> DataFrame:
    """``node, depth`` of what outgoing edges reach within ``max_depth`` steps; the source itself has depth 0."""
    spark = graph.sparkSession
    edges = graph.select("subject", "object").distinct()
    seen = spark.createDataFrame([(source, 0)], "node string, depth int")
    front = seen
    for depth in range(1, max_depth + 1):
        new = edges.join(front.select(F.col("node").alias("subject")), "subject").select(F.col("object").alias("node")).distinct()
        front = staged(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def dfs(graph: DataFrame, source: str, max_depth: int, most_edges: int = 1_000_000) -> DataFrame:
    """``place, node, depth`` in the order of a depth-first search: of a node's edges the last by ``seq`` is followed first.

    The order depends on all that came before, so it is found in one task, from the edges within reach alone; more
    than ``most_edges`` of those are an error.
    """
    near = subgraph(graph, source, max_depth).select("seq", "subject", "object")
    n = near.limit(most_edges + 1).count()
    if n > most_edges:
        raise ValueError(f"over {most_edges} edges lie within {max_depth} steps of {source}")
    rows = near.sparkSession.range(1).select(F.lit(None).cast(near.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("object"))

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, int] = {}
        edges: dict[str, list[str]] = {}
        for s, o in pdf[pdf["subject"].notna()].sort_values("seq")[["subject", "object"]].itertuples(index=False):
            edges.setdefault(s, []).append(o)
        stack = [(source, 0)]
        while stack:
            node, depth = stack.pop()
            if node not in out:
                out[node] = depth
                if depth < max_depth:
                    stack += [(o, depth + 1) for o in edges.get(node, []) if o not in out]
        return pd.DataFrame([(i, n, d) for i, (n, d) in enumerate(out.items())], columns=["place", "node", "depth"])

    return near.unionByName(rows).withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(visit, "place long, node string, depth int")


def subgraph(graph: DataFrame, entity: str, depth: int) -> DataFrame:
    """Edges out of the nodes within ``depth`` steps."""
    near = bfs(graph, entity, depth).select(F.col("node").alias("subject"))
    return graph.join(near, "subject", "left_semi").select(graph.columns)


def shortest_paths(graph: DataFrame, source: str, max_rounds: int = 100) -> DataFrame:
    """``node, cost, path`` of the cheapest way from ``source``; an edge costs 1 less its confidence.

    Relaxes all edges a round until no cost falls; of equal costs the first path by order stays.
    """
    spark = graph.sparkSession
    edges = graph.select("subject", "object", (1 - F.col("confidence")).alias("w"))
    best = spark.createDataFrame([(source, 0.0, [source])], "node string, cost double, path array<string>")
    front = best
    for _ in range(max_rounds):
        step = front.join(edges, front.node == edges.subject).select(F.col("object").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("object")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("s")).select("node", "s.*")
        old = best.select("node", F.col("cost").alias("old"))
        front = staged(step.join(old, "node", "left").where("old is null or cost < old - 1e-12").select("node", "cost", "path"), "paths-front")
        if front.isEmpty():
            return best
        best = staged(best.join(front.select("node"), "node", "left_anti").unionByName(front), "paths-best")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def astar(graph: DataFrame, source: str, target: str, heuristic: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """``cost, path, nodes_explored`` of the cheapest way to ``target``, or no row; ``heuristic`` holds ``node, h``, never over the true rest.

    Whole frontiers are relaxed as in :func:`shortest_paths`; nodes whose cost and rest exceed the best known way are not
    followed. ``nodes_explored`` counts the nodes that were.
    """
    spark = graph.sparkSession
    edges = graph.select("subject", "object", (1 - F.col("confidence")).alias("w"))
    h = spark.createDataFrame([], "node string, h double") if heuristic is None else heuristic.select("node", "h")
    best = spark.createDataFrame([(source, 0.0, [source])], "node string, cost double, path array<string>")
    front, explored = best, []
    for _ in range(max_rounds):
        known = best.where(F.col("node") == target).select("cost").first()
        open_ = front.where(F.col("node") != target).join(h, "node", "left")
        if known is not None:
            open_ = open_.where(F.col("cost") + F.coalesce("h", F.lit(0.0)) < known[0])
        open_ = staged(open_.select("node", "cost", "path"), "astar-open")
        if open_.isEmpty():
            break
        explored.append(open_.select("node"))
        step = open_.join(edges, open_.node == edges.subject).select(F.col("object").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("object")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("s")).select("node", "s.*")
        old = best.select("node", F.col("cost").alias("old"))
        front = staged(step.join(old, "node", "left").where("old is null or cost < old - 1e-12").select("node", "cost", "path"), "astar-front")
        best = staged(best.join(front.select("node"), "node", "left_anti").unionByName(front), "astar-best")
    else:
        raise RuntimeError(f"no way settled after {max_rounds} rounds")
    seen = spark.createDataFrame([], "node string")
    for nodes_ in explored:
        seen = seen.unionByName(nodes_)
    return best.where(F.col("node") == target).select("cost", "path").crossJoin(seen.agg(F.count_distinct("node").alias("nodes_explored")))


def pagerank(graph: DataFrame, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """``node, rank``, the rounds taken and whether the ranks settled; parallel edges count, dangling mass goes to all."""
    edges = staged(graph.select("subject", "object"), "rank-graph")
    degree = edges.groupBy("subject").agg(F.count("*").alias("degree"))
    nodes = staged(edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct().join(degree.withColumnRenamed("subject", "node"), "node", "left"), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank")), 0, True
    # Tasks of a bounded number of edges, however large the tables: their sorts and sums then stay small.
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // RANK_ROWS))
    pairs = edges.repartition(parts, "subject", "object").groupBy("subject", "object").agg(F.count("*").alias("n"))
    edges = staged(pairs.join(degree.repartition(parts, "subject"), "subject").select("subject", "object", (F.col("n") / F.col("degree")).alias("share")), "rank-edges")
    ranks = nodes.select("node", "degree", F.lit(1.0 / n).alias("rank"))
    for round_ in range(1, max_rounds + 1):
        # One job a round: the ranks of nodes without a way out join as a single row.
        dangling = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        at = ranks.select(F.col("node").alias("subject"), "rank").repartition(parts, "subject")
        into = edges.join(at, "subject").groupBy(F.col("object").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(into, "node", "left").crossJoin(F.broadcast(dangling)).select(
            "node", "degree", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        new = staged(new, "rank-round")
        ranks = new.select("node", "degree", "rank")
        if tolerance > 0 and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            return ranks.select("node", "rank"), round_, True
    return ranks.select("node", "rank"), max_rounds, False


def components(graph: DataFrame) -> DataFrame:
    """``component, size, members``' table: ``node, component, size`` with a component named by its least node."""
    found = connected_components(graph.select(F.col("subject").alias("src"), F.col("object").alias("dst")))
    sizes = staged(found.groupBy("component").agg(F.count("*").alias("size")), "component-sizes")  # a join that may split a giant component
    return found.join(sizes, "component").select("node", "component", "size")


def are_connected(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, connected``; a node is connected to itself even if it is unknown."""
    c = components(graph).select("node", "component")
    out = pairs.join(c.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return out.select("a", "b", ((F.col("a") == F.col("b")) | F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).alias("connected"))


def merge(base: DataFrame, new: DataFrame, strategy: str = "union") -> DataFrame:
    """``base`` with the triples of ``new``; of triples in both the strategy says which stays (column ``origin``)."""
    b = base.select(*TRIPLE, F.struct("confidence", "source").alias("b"))
    n = new.select(*TRIPLE, F.struct("confidence", "source").alias("n"))
    both = b.join(n, TRIPLE, "full")
    better = {"union": F.lit(False), "max_confidence": F.col("n.confidence") > F.col("b.confidence"), "source_priority": priority(F.col("n.source")) > priority(F.col("b.source"))}[strategy]
    take = F.col("b").isNull() | F.coalesce(F.col("n").isNotNull() & better, F.lit(False))
    origin = F.when(F.col("b").isNull(), "added").when(take, "updated").otherwise("kept")
    chosen = F.when(take, F.col("n")).otherwise(F.col("b"))
    return both.select(*TRIPLE, chosen["confidence"].alias("confidence"), chosen["source"].alias("source"), origin.alias("origin"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples added, removed or changed in confidence."""
    both = old.select(*TRIPLE, F.col("confidence").alias("c_old")).join(new.select(*TRIPLE, F.col("confidence").alias("c_new")), TRIPLE, "full")
    status = F.when(F.col("c_old").isNull(), "added").when(F.col("c_new").isNull(), "removed").when(F.abs(F.col("c_old") - F.col("c_new")) > 2.220446049250313e-16, "changed")
    return both.withColumn("status", status).where("status is not null")


def filtered(
    graph: DataFrame, *, min_confidence: float | None = None, max_confidence: float | None = None, relations: list[str] | None = None,
    without_relations: list[str] | None = None, sources: list[str] | None = None, subject_contains: str | None = None, object_contains: str | None = None,
    layer_min: int | None = None, layer_max: int | None = None, selectivity_min: float | None = None, c_in_min: float | None = None, c_out_min: float | None = None,
) -> DataFrame:
    """Edges that pass all given predicates; those on ``metadata`` (a map) fail where the key is missing."""
    tests: list[Column] = []
    value = lambda key: F.col("metadata")[key].cast("double")
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        tests.append(F.col("confidence") <= max_confidence)
    if relations is not None:
        tests.append(F.col("relation").isin(relations))
    if without_relations is not None:
        tests.append(~F.col("relation").isin(without_relations))
    if sources is not None:
        tests.append(F.col("source").isin(sources))
    if subject_contains is not None:
        tests.append(F.contains("subject", F.lit(subject_contains)))
    if object_contains is not None:
        tests.append(F.contains("object", F.lit(object_contains)))
    for key, low, high in (("layer", layer_min, layer_max), ("selectivity", selectivity_min, None), ("c_in", c_in_min, None), ("c_out", c_out_min, None)):
        if low is not None:
            tests.append(F.coalesce(value(key) >= low, F.lit(False)))
        if high is not None:
            tests.append(F.coalesce(value(key) <= high, F.lit(False)))
    for test in tests:
        graph = graph.where(test)
    return graph


def nodes(graph: DataFrame, type_rules: DataFrame | None = None) -> DataFrame:
    """``node, degree, out_degree, in_degree, node_type``; ``type_rules(rule_no, node_type, outgoing, incoming)``, the first that fits."""
    ends = graph.select(F.col("subject").alias("node"), "relation", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        graph.select(F.col("object").alias("node"), "relation", F.lit(0).alias("o"), F.lit(1).alias("i")))
    by = ends.groupBy("node").agg(
        F.count("*").alias("degree"), F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
        F.collect_set(F.when(F.col("o") == 1, F.col("relation"))).alias("outs"), F.collect_set(F.when(F.col("i") == 1, F.col("relation"))).alias("ins"))
    if type_rules is None:
        return by.select("node", "degree", "out_degree", "in_degree", F.lit(None).cast("string").alias("node_type"))
    fits = F.arrays_overlap("outs", "outgoing") | F.arrays_overlap("ins", "incoming")
    typed = by.join(F.broadcast(type_rules), fits, "left")  # a schema's few rules
    return typed.groupBy("node", "degree", "out_degree", "in_degree").agg(F.min_by("node_type", "rule_no").alias("node_type"))


def stats(graph: DataFrame) -> DataFrame:
    """One row: entities, edges, relations, average confidence and degree, components, and the edges of each source."""
    ends = graph.select(F.explode(F.array("subject", "object")).alias("node")).distinct().agg(F.count("*").alias("entities"))
    row = graph.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    parts = components(graph).agg(F.count_distinct("component").alias("components"))
    sources = graph.groupBy("source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return row.crossJoin(ends).crossJoin(parts).crossJoin(sources).withColumn("avg_degree", F.when(F.col("entities") > 0, 2.0 * F.col("edges") / F.col("entities")).otherwise(0.0))


def counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy("relation", "source").agg(F.count("*").alias("edges"), F.avg("confidence").alias("avg_confidence"))


def edges_of(rows: DataFrame) -> DataFrame:
    """Edges of rows that may lack ``confidence`` (1 then, and held to 0..1), ``source`` (unknown) or ``metadata`` (none)."""
    given = lambda name, kind, default: F.coalesce(F.col(name).cast(kind), default) if name in rows.columns else default
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given("confidence", "double", F.lit(1.0))))
    none = F.create_map().cast("map<string,string>")
    return rows.select(*TRIPLE, confidence.alias("confidence"), given("source", "string", F.lit("unknown")).alias("source"), given("metadata", "map<string,string>", none).alias("metadata"))


def chain(predict: Callable[[str], list[tuple[str, float]]], prompt: str, most: int = 8, least: float = 0.0, stops: str = ".\n") -> tuple[str, float, float]:
    """Repeat the best prediction: the answer, its average and least probability; ends on nothing, a stop character or a weak guess."""
    answer, chances = "", []
    for _ in range(most):
        found = predict(prompt + answer)
        if not found or found[0][1] < least or any(c in stops for c in found[0][0]):
            break
        answer += found[0][0]
        chances.append(found[0][1])
    return answer.strip(), (sum(chances) / len(chances) if chances else 0.0), min(chances, default=0.0)


def extract_bfs(seeds: DataFrame, templates: DataFrame, answers: Callable[[DataFrame], DataFrame], least: float = 0.3, max_depth: int = 3, max_entities: int = 1000) -> DataFrame:
    """Crawl a model: ask each new entity each template, keep sure answers as edges, go on with those that look like entities.

    ``answers`` adds ``answer, probability`` to rows ``subject, relation, prompt``. The crawl ends at
    ``max_depth`` or once ``max_entities`` were asked, which are its parameters.
    """
    seen = front = staged(seeds.select(F.col("entity").alias("subject")).distinct(), "crawl-front")
    edges = None
    for depth in range(max_depth + 1):
        asked = front.crossJoin(F.broadcast(templates)).withColumn("prompt", F.replace("template", F.lit("{subject}"), F.col("subject")))
        got = answers(asked.select("subject", "relation", "prompt")).where((F.trim("answer") != "") & (F.col("probability") >= least))
        got = staged(got.select("subject", "relation", F.trim("answer").alias("object"), F.col("probability").alias("confidence"), F.lit(depth).alias("depth")), "crawl-edges")
        edges = got if edges is None else edges.unionByName(got)
        room = max_entities - seen.count()
        if depth == max_depth or room <= 0:
            break
        new = got.where(is_valid_entity("object")).select(F.col("object").alias("subject")).distinct().join(seen, "subject", "left_anti")
        front = staged(new.orderBy("subject").limit(room), "crawl-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return edges.dropDuplicates(TRIPLE)
