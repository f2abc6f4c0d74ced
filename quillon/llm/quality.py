"""Quality scores by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from quillon.llm.common import whole

#: Classes of characters: one for each of these, and for other letters, upper and lower case, digits, blanks, the rest.
MARKS = "\n .,;:!?|$%&#*@/-_'\"()[]{}<>=+\\~^`"
KINDS = len(MARKS) + 6
WIDTH = KINDS * KINDS + 4


def _classes() -> np.ndarray:
    table = np.full(0x250 + 1, len(MARKS) + 5, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if ch in MARKS:
            table[c] = MARKS.index(ch)
        elif ch.isdigit():
            table[c] = len(MARKS)
        elif ch.isspace():
            table[c] = len(MARKS) + 1
        elif ch.isupper():
            table[c] = len(MARKS) + 2
        elif ch.isalpha():
            table[c] = len(MARKS) + (3 if ch in "aeiouyàáâäèéêëìíîïòóôöùúûü" else 4)
    return table


CLASSES = _classes()


def features(text: str) -> np.ndarray:
    """Root frequencies of pairs of character classes, then length, share of repeated lines and words, word length."""
    out = np.zeros(WIDTH, np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = CLASSES[np.minimum(codes, 0x250)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        out[: KINDS * KINDS] = np.sqrt(pairs / (len(kinds) - 1))
    lines, words = text.split("\n"), text.split()
    out[-4] = np.log1p(len(text)) / 10
    out[-3] = 1 - len(set(lines)) / len(lines)
    if words:
        out[-2] = 1 - len(set(words)) / len(words)
        out[-1] = min(len(text) / len(words), 40) / 10
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) that minimise the non-negative unbiased risk for the logistic loss.

    Risk of the positives, ``prior * E_p[l(g)]``, plus that of the negatives as unlabelled less positive,
    ``E_u[l(-g)] - prior * E_p[l(-g)]``; where the latter falls below zero its gradient is turned round.
    Deterministic: full batches, Adam from zero.
    """
    used = np.append((positive != 0).any(0) | (unlabelled != 0).any(0), True)
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)])[:, used]
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)])[:, used]
    w, m, v = (np.zeros(p.shape[1], np.float32) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        gp, gu = p @ w, u @ w
        as_positive = -prior * (sigmoid(-gp) @ p) / len(p)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_negative = (sigmoid(gu) @ u) / len(u) - prior * (sigmoid(gp) @ p) / len(p)
        grad = as_positive + as_negative if negative_risk >= 0 else -as_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(len(used))
    out[used] = w
    return out


def estimated_prior(scores_positive: np.ndarray, scores_unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, where no labelled sample of both kinds tells it.

    The least ratio, over thresholds, of what is below a score among the unlabelled and among the positives, taken from above.
    """
    cuts = np.quantile(scores_positive, np.linspace(0.05, 0.5, 10))
    return float(np.clip(min((scores_unlabelled >= c).mean() / max((scores_positive >= c).mean(), 1e-9) for c in cuts), 0.05, 0.95))


def place_of(id_col: str, text_col: str) -> Column:
    """The place of a row in [0, 1), by a digest of id and text: rows that share an id are dealt apart."""
    return F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)


def sampled(rows: DataFrame, id_col: str, text_col: str, count: int, most: int) -> np.ndarray:
    """Features of about ``most`` rows (expected), chosen by a digest, equal texts once; computed on the executors."""
    chosen = rows.where(place_of(id_col, text_col) < F.lit(min(1.0, most / max(1, count)))).select(whole(text_col).alias("text")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [features(t.as_py()).tobytes() for t in batch.column(0)[at : at + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["f"])

    found = chosen.mapInArrow(measure, "f binary").toPandas()["f"]
    return np.array(sorted(found), dtype=object) if found.empty else np.stack([np.frombuffer(b, np.float32) for b in sorted(found)])


def learned(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str,
    most_positive: int, most_unlabelled: int,
) -> np.ndarray | None:
    """Weights from trusted positives and unlabelled texts of the rows that may be learned from; None without positives.

    The class prior is the share of label 1 among the labelled rows that may be learned from.
    """
    known = labels.where(F.col(label_col).isNotNull()).where(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).alias("label"))
    ids = docs.where(learn).select(F.col(id_col).alias("id")).join(known, F.col("id") == F.col("known_id"))
    shares = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    n_positive, n_labelled = shares.get(1, 0), sum(shares.values())
    if not n_positive:
        return None
    # The bounded sample is taken before the join: few rows carry their texts into it.
    few = known.where("label = 1")
    some = docs.where(learn).where(place_of(id_col, text_col) < F.lit(min(1.0, most_positive / n_positive))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = some.join(few, F.col("id") == F.col("known_id"), "left_semi")
    positive = sampled(trusted, "id", "text", n_positive, most_positive)
    n_docs = docs.where(learn).count()
    unlabelled = sampled(docs.where(learn), id_col, text_col, n_docs, most_unlabelled)
    if not len(positive) or not len(unlabelled):
        return None
    prior = n_positive / n_labelled
    if n_positive == n_labelled:  # positives alone are labelled
        w = fit(positive, unlabelled, 0.5)
        prior = estimated_prior(positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1])
    return fit(positive, unlabelled, float(np.clip(prior, 0.01, 0.99)))


def _score(text: str, weights: np.ndarray | None) -> float:
    if weights is None:
        return 0.5
    z = float(features(text) @ weights[:-1] + weights[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _text_scores(weights: np.ndarray | None):
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([_score(t, weights) for t in texts], dtype=float)

    return score


def _scorer(weights: np.ndarray | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([_score(t.as_py(), weights) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["key", "held_out", "score"])

    return score


def scored(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_positive: int = 2000, most_unlabelled: int = 4000, threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text: how likely it has label 1.

    A logistic model of character-class pairs and repetition, fitted by non-negative positive-unlabelled
    learning on a bounded sample (``most_positive`` trusted positives and ``most_unlabelled`` texts, both
    expected numbers) of the rows that are not ``held_out``. Labels, languages, sources and ids are no
    inputs of a score. Null texts count as empty and get the score of an empty text; without any positive
    label every score is 0.5. Repeated rows are kept, and learned from once; of an id with several labels the
    greatest counts; an empty table gives an empty result; extra columns are not read. A very long text is measured
    as a whole, in one task.
    """
    weights = learned(docs, labels, ~held_out, id_col, text_col, label_col, most_positive, most_unlabelled)
    out = _scores(docs, F.col(id_col), weights, text_col, held_out).withColumnRenamed("key", "doc_id")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scores(docs: DataFrame, key: Column, weights: np.ndarray | None, text_col: str, held_out: Column) -> DataFrame:
    rows = docs.select(key.alias("key"), whole(text_col).alias("text"), held_out.alias("held_out"))
    schema = StructType([rows.schema["key"], StructField("held_out", BooleanType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_scorer(weights), schema)


def accepted(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_positive: int = 2000, most_unlabelled: int = 4000, threshold: float = 0.3,
) -> DataFrame:
    """The rows of ``docs`` that :func:`scored` predicts to have label 1, all columns as they were and in no join."""
    weights = learned(docs, labels, ~held_out, id_col, text_col, label_col, most_positive, most_unlabelled)
    # Only texts go to Python, and only scores come back.
    return docs.where(F.pandas_udf(_text_scores(weights), "double")(whole(text_col)) >= threshold)
