"""A feature store derived from the tables: vocabulary, token embeddings, features with labels.

Layer = ``embeddings.label``, feature = ``vec_id``, gate = the embedding; the vocabulary is the most
frequent words of ``documents``, one per vector; a feature's label is the token that its output vector
(the embedding of another feature, by a fixed stride) points to most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ordering import numbered
from quillon.operators.products import best
from quillon.staging import age, staged

SCALE = 80.0
WORD = "[a-zà-öø-ÿ]+"
#: Bytes of text that a task takes apart at once, about.
PART_BYTES = 16 << 20
_KNOWN: dict[tuple[str, int, str, int, int], Model] = {}


@dataclass
class Model:
    """Tables of one model; ``tokens(token_id, word, token, embedding)``, ``features(layer, feature, gate, token_id, token, c_score, top_k)``.

    The features' labels, which take all pairs of vectors and tokens, are found when ``features`` is first asked for; ``gates(layer, feature, gate)`` does without.
    """

    name: str
    tokens: DataFrame
    labelled: DataFrame | Callable[[], DataFrame]
    layers: int
    size: int
    scale: float = SCALE
    unlabelled: DataFrame | None = None

    @property
    def features(self) -> DataFrame:
        if not isinstance(self.labelled, DataFrame):
            self.labelled = self.labelled()
        return self.labelled

    @property
    def gates(self) -> DataFrame:
        return self.features.select("layer", "feature", "gate") if self.unlabelled is None else self.unlabelled

    @property
    def with_meta(self) -> DataFrame:
        return self.features.where("token is not null")


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Bytes of UTF-8 that are letters of a word, and those that are after 0xC3.
_LETTER, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_SECOND[[c.encode()[1] for c in map(chr, range(0xE0, 0x100)) if c != "÷"]] = True


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts after each other, as :func:`words_of` finds them, and how many words each text has."""
    raw = [("" if t is None else t).lower().encode() for t in texts.to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    letter = _LETTER[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    pair = pair[_SECOND[data[pair + 1]]]
    letter[pair] = letter[pair + 1] = True
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[letter].tobytes()))
    stops = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return words, np.diff(np.searchsorted(first, stops), prepend=0)


def parts_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """A batch's texts some at a time, so that what is made of them stays small, and where they begin."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a batch's texts, each word once a part of it."""
    for batch in batches:
        for _, texts in parts_of(batch.column(0)):
            found = split_words(texts)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each word occurs; tasks count before anything is shuffled."""
    return texts.select(text).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _labelled(gates: DataFrame, tokens: DataFrame, n: int, stride: int, offset: int, top: int) -> DataFrame:
    """The features with their labels; every output vector meets the whole vocabulary, in blocks."""
    down = gates.select(F.col("vec_id").alias("down_id"), F.col("gate").alias("down"))
    out = gates.select("vec_id", ((F.col("vec_id") * stride + offset) % n).alias("down_id")).join(down, "down_id")
    logits = best(out.select("vec_id", "down"), tokens.select("token_id", "token", "embedding"), top, ["token_id"], left_vector="down", right_vector="embedding", key=["vec_id"])
    logits = logits.select("vec_id", "token_id", "token", F.col("score").alias("logit"), F.col("rank").alias("r"))
    meta = logits.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("r", "token", "token_id", "logit"))).alias("t"))
    meta = meta.where("vec_id % 17 <> 0").select(
        F.col("vec_id").alias("feature"),
        F.col("t")[0]["token_id"].alias("token_id"), F.col("t")[0]["token"].alias("token"), F.col("t")[0]["logit"].alias("c_score"),
        F.transform("t", lambda e: F.struct(e["token"].alias("token"), e["token_id"].alias("token_id"), e["logit"].alias("logit"))).alias("top_k"),
    )
    features = gates.select(F.col("label").alias("layer"), F.col("vec_id").alias("feature"), "gate").join(meta, "feature", "left")
    return staged(features.select("layer", "feature", "gate", "token_id", "token", "c_score", "top_k"), "model-features")


def derive(spark: SparkSession, sf_dir: str, stride: int = 7, offset: int = 1, top: int = 5) -> Model:
    """The model of the tables in ``sf_dir``; written once per session.

    The vocabulary has as many tokens as there are vectors. The labels are found once a query asks for ``features``.
    """
    key = (spark.sparkContext.applicationId, age(spark), sf_dir, stride, offset)
    if key in _KNOWN:
        return _KNOWN[key]
    docs, vectors = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.count()
    counted = word_counts(docs)
    ranked = numbered(counted, [F.desc("n"), F.col("word")], "token_id").where(F.col("token_id") < n).select("token_id", "word")
    gates = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("gate"))
    gates = staged(gates, "model-gates")
    token = F.when(F.col("token_id") % 3 == 0, F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word"))
    tokens = ranked.withColumn("token", token).join(gates.select(F.col("vec_id").alias("token_id"), F.col("gate").alias("embedding")), "token_id")
    tokens = staged(tokens, "model-tokens")
    layers = (gates.agg(F.max("label")).first()[0] or 0) + 1
    unlabelled = gates.select(F.col("label").alias("layer"), F.col("vec_id").alias("feature"), "gate")
    model = Model(f"derived-{stride}-{offset}", tokens, lambda: _labelled(gates, tokens, n, stride, offset, top), layers, n, unlabelled=unlabelled)
    _KNOWN[key] = model
    return model
