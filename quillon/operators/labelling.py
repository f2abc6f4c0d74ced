"""Names for clusters of features: by category words, by what their members are, by known relations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import l2_normalize
from quillon.functions.vocabularies import CATEGORIES, COUNTRIES, LANGUAGES, MONTHS, NUMBERS
from quillon.operators.clustering import kmeans, output_labels, tfidf_labels
from quillon.operators.products import best
from quillon.staging import staged

#: Members of a cluster that its category is found by, and the least mean cosine that names one.
MEMBERS, LEAST = 10, 0.25


def entity_pattern(members: Column | str) -> Column:
    """What at least half of an array of words are: language, country, month, number or morphological; null if none."""
    lower = F.transform(members, F.lower)
    half = F.ceil(F.size(members) / 2)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(lower, lambda m: m.isin(words))) >= half

    short = F.size(F.filter(lower, lambda m: m.rlike("^[a-z]{0,4}$"))) >= half
    out = F.when(hits(LANGUAGES), "language").when(hits(COUNTRIES), "country").when(hits(MONTHS), "month").when(hits(NUMBERS), "number").when(short, "morphological")
    return F.when(F.size(members) > 0, out)


def category_words(spark: SparkSession, *paths: str) -> DataFrame:
    """``position, word`` of the first of ``paths`` that exists and is a JSON list of words, else the built-in ones."""
    for path in paths:
        try:
            words = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "word")).where("word is not null")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if not words.isEmpty():
            return words
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "position int, word string")


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<pairs: array<array<string>>>>")).alias("relation", "r"))
    return rows.select("relation", F.explode("r.pairs").alias("p"))


def relation_database(spark: SparkSession, path: str) -> DataFrame:
    """``relation, subject_lc, object_lc`` of a file ``{relation: {"pairs": [[subject, object], ...]}}``; empty ends are left out."""
    rows = _pairs(spark, path).where(F.size("p") >= 2)
    rows = rows.select("relation", F.lower(F.col("p")[0]).alias("subject_lc"), F.lower(F.col("p")[1]).alias("object_lc"))
    return rows.where("subject_lc <> '' and object_lc <> ''")


def probe_entities(spark: SparkSession, path: str) -> DataFrame:
    """``entity``: the different names in a file of relations that can be asked about, 2 to 30 bytes and no note or address."""
    rows = _pairs(spark, path).select(F.explode("p").alias("entity")).select(F.trim("entity").alias("entity")).distinct()
    return rows.where(F.octet_length("entity").between(2, 30) & ~F.contains("entity", F.lit("(")) & ~F.contains("entity", F.lit("http")))


def known_relations(database: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, relation`` of the rows ``id, subject, object`` that a relation is known to hold for, however cased."""
    asked = pairs.select("id", F.lower("subject").alias("subject_lc"), F.lower("object").alias("object_lc"))
    return asked.join(database, ["subject_lc", "object_lc"]).select("id", "relation")


def word_vectors(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``words`` (column ``word``) that are tokens, with ``v`` of norm 1; the first three tokens, which mark beginnings, have none."""
    known = tokens.where("token_id > 2").groupBy(F.lower("word").alias("word")).agg(F.min_by("embedding", "token_id").alias("e"))
    return words.join(known, "word").withColumn("v", l2_normalize("e")).drop("e").where(F.exists("v", lambda x: x != 0))


def category_labels(members: DataFrame, tokens: DataFrame, categories: DataFrame) -> DataFrame:
    """``cluster, label, tokens`` from rows ``cluster, feature, text``, as :func:`tfidf_labels` takes them.

    The label is the category word (``position, word``) whose vector is nearest to the mean of the vectors of the
    cluster's best tokens, the first of equals, from ``LEAST`` on; else what :func:`entity_pattern` says of the tokens;
    else the label by frequency.
    """
    plain = staged(tfidf_labels(members), "labels-tfidf")
    own = plain.select("cluster", F.explode(F.slice("tokens", 1, MEMBERS)).alias("word"))
    vectors = own.join(word_vectors(own.select("word").distinct(), tokens), "word").select("cluster", F.posexplode("v").alias("dim", "x"))
    means = vectors.groupBy("cluster", "dim").agg(F.avg("x").alias("x")).groupBy("cluster")
    means = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("mean"))
    words = word_vectors(categories.select(F.lower("word").alias("word"), "position"), tokens)
    near = best(means, words.select("position", "word", "v"), 1, ["position"], left_vector="mean", right_vector="v", key=["cluster"])
    near = near.where(F.col("score") >= LEAST).select("cluster", F.col("word").alias("category"))
    # A cluster none of whose tokens has a vector keeps its label by frequency.
    found = plain.join(near, "cluster", "left").join(means.select("cluster", F.lit(True).alias("met")), "cluster", "left")
    return found.select("cluster", F.coalesce("category", F.when(F.col("met"), entity_pattern("tokens")), "label").alias("label"), "tokens")


def relation_labels(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """``layer, feature, relation``: the label of a feature's cluster, else its tokens joined by ``/``; features of nameless clusters are left out."""
    named = clusters.select("cluster", F.coalesce("label", F.array_join("tokens", "/")).alias("relation"))
    return assignments.join(named, "cluster").where("relation <> ''").select("layer", "feature", "relation")


def labelled_clusters(features: DataFrame, tokens: DataFrame, categories: DataFrame, relations: DataFrame | None = None, k: int = 512, max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Cluster directions and name the clusters: ``layer, feature, cluster`` and ``cluster, label, count, tokens``.

    From rows ``layer, feature, direction, out_token, text``. Labels by the outputs' known relations come
    before those by category words (:func:`category_labels`).
    """
    rows = staged(features.where("direction is not null").withColumn("id", F.concat_ws(":", "layer", "feature")), "cluster-rows")
    found, _ = kmeans(rows.select("id", F.col("direction").alias("v")), min(k, max(1, rows.count())), max_rounds)
    placed = staged(rows.join(found.select("id", "cluster"), "id"), "cluster-placed")
    labels = category_labels(placed.select("cluster", F.col("id").alias("feature"), "text"), tokens, categories)
    if relations is not None:
        by_output = output_labels(placed.select("cluster", "out_token"), relations).select("cluster", F.col("relation").alias("known"))
        labels = labels.join(by_output, "cluster", "left").select("cluster", F.coalesce("known", "label").alias("label"), "tokens")
    counts = placed.groupBy("cluster").agg(F.count("*").alias("count"))
    return placed.select("layer", "feature", "cluster"), labels.join(counts, "cluster").select("cluster", "label", "count", "tokens")
