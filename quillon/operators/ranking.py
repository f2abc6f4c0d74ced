"""Ranking a text column by several signals at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.knowledge import ranked
from quillon.plans.model import Model


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(text: Column | str) -> Column:
    """The different runs of three characters of a text's words, each led by two blanks and ended by one."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(_words(text), of)))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Common runs of three characters as a share of all; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def word_share(text: Column | str, query: Column | str) -> Column:
    """The share of a query's different words that a text has; 0 without any."""
    asked = F.array_distinct(_words(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, _words(text))) / F.size(asked)).otherwise(0.0)


def hybrid_rank(candidates: DataFrame, query: str, model: Model, limit: int = 10, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """``id, score`` and the signals of the best ``limit`` texts (``id, text``): nearness in the model, trigrams, shared words.

    Nearness is one less the distance, 0 where the model knows no word of a text; null texts have no signal.
    """
    near = ranked(candidates, query, model).select("id", (1 - F.least("distance", F.lit(1.0))).alias("near"))
    asked = F.lit(query)
    rows = candidates.join(near, "id", "left").select(
        "id", F.coalesce("near", F.lit(0.0)).alias("near"), F.coalesce(trigram_similarity("text", asked), F.lit(0.0)).alias("trigram"), F.coalesce(word_share("text", asked), F.lit(0.0)).alias("words"))
    rows = rows.withColumn("score", weights[0] * F.col("near") + weights[1] * F.col("trigram") + weights[2] * F.col("words"))
    return rows.orderBy(F.round("score", 9).desc(), "id").limit(limit)
