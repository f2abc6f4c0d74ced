"""Language identification by cross-parsing: phrases that suffix automata of labelled text need."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import whole
from quillon.staging import staged

#: Symbols that one lane parses, and characters parsed at once.
LANE, BATCH_CHARS = 128, 2_000_000


@cache
def _letters() -> np.ndarray:
    """For every code point 1 where it is a letter or a mark on one, else 0."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)], np.int32)


def alphabet(letters: Iterable[str]) -> np.ndarray:
    """The symbol of every code point. 0: no letter, 1: a letter that is not among ``letters``, from 2 on: those."""
    table = _letters().copy()
    codes = sorted({ord(c) for c in letters if table[ord(c)]})
    table[codes] = np.arange(len(codes)) + 2
    return table


@cache
def _latin() -> np.ndarray:
    return alphabet(chr(c).lower() for c in range(0x250) if len(chr(c).lower()) == 1)


def symbols_of(text: str, table: np.ndarray | None = None) -> np.ndarray:
    """Symbols of a lower-cased text by :func:`alphabet` (of the Latin letters by default), runs of anything else as one separator."""
    table = _latin() if table is None else table
    out = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(out) > 1:
        out = out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]
    return out


def automaton(text: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Transitions ``[state, symbol]`` of the suffix automaton of ``text``; -1 where a match ends. State 0 is the root."""
    symbols = int(_latin().max()) + 1 if symbols is None else symbols
    nexts: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p != -1:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[new] = clone
        last = new
    out = np.full((len(nexts), symbols), -1, np.int32)
    for i, row in enumerate(nexts):
        for c, j in row.items():
            out[i, c] = j
    return out


def phrases(lanes: np.ndarray, lengths: np.ndarray, before: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """How many phrases begin in each lane (columns of ``lanes``, longest first) when texts are tiled by longest matches.

    A text's lanes follow each other: ``before`` is the column of the lane ahead, -1 for a text's first. All lanes
    advance together, one symbol a step, first as if a phrase began with each; then those that the lane ahead enters
    amid a phrase again, from its last state on, until they fall in with what they were. A symbol that the
    automaton's text lacks is a phrase.
    """
    flat, root, width = nexts.ravel(), nexts[0], nexts.shape[1]
    states, begins = np.zeros(lanes.shape, np.int32), np.zeros(lanes.shape, bool)
    after = np.full(len(before), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)

    def advanced(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = flat[state.astype(np.int64) * width + c]
        over = here < 0
        return np.where(over, np.maximum(root[c], 0), here), over | (state == 0)

    state = np.zeros(lanes.shape[1], np.int32)
    for t, row in enumerate(lanes):
        n = int(np.searchsorted(-lengths, -t, "left"))
        states[t, :n], begins[t, :n] = advanced(state[:n], row[:n])
        state = states[t, :n]
    entered = np.flatnonzero(before >= 0)
    while len(entered):
        ahead = before[entered]
        state = states[lengths[ahead] - 1, ahead]
        columns, state = entered[state != 0], state[state != 0]
        changed = []
        for t in range(len(lanes)):
            n = int(np.searchsorted(-lengths[columns], -t, "left"))
            changed.append(columns[n:])
            columns, state = columns[:n], state[:n]
            if not n:
                break
            state, begin = advanced(state, lanes[t, columns])
            differ = state != states[t, columns]
            states[t, columns], begins[t, columns] = state, begin
            columns, state = columns[differ], state[differ]
        changed.append(columns)
        entered = after[np.concatenate(changed)]
        entered = np.sort(entered[entered >= 0])
    return begins.sum(0)


def rates(texts: list[np.ndarray], automata: list[np.ndarray]) -> np.ndarray:
    """Phrases per symbol of each text (rows) against each automaton (columns)."""
    pieces, owner, ahead = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, len(t), LANE):
            ahead.append(len(pieces) - 1 if a else -1)
            pieces.append(t[a : a + LANE])
            owner.append(i)
    out = np.zeros((len(texts), len(automata)))
    if not pieces:
        return out
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    lanes = np.zeros((len(pieces), LANE), np.int32)
    lengths = lengths[order]
    lanes[np.arange(LANE) < lengths[:, None]] = np.concatenate([pieces[i] for i in order])
    lanes = np.ascontiguousarray(lanes.T)
    column = np.empty(len(pieces), np.int64)
    column[order] = np.arange(len(pieces))
    ahead = np.array(ahead)[order]
    before = np.where(ahead >= 0, column[ahead], -1)
    owner = np.array(owner)[order]
    size = np.maximum(1, np.bincount(owner, lengths, len(texts)))
    for j, nexts in enumerate(automata):
        out[:, j] = np.bincount(owner, phrases(lanes, lengths, before, nexts), len(texts)) / size
    return out


def learned_texts(docs: DataFrame, learn: Column, lang_col: str, text_col: str, id_col: str, rows_per_lang: int, chars_per_row: int, chars_per_lang: int) -> dict[str, str]:
    """Labelled text per language: different whole rows in the order of a digest, until ``chars_per_lang`` characters are reached.

    From about ``rows_per_lang`` rows of at most ``chars_per_row`` characters; of a language without any such row the shortest.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.char_length(text_col).alias("chars"))
    counts = known.groupBy("lang").agg(F.count_if(F.col("chars") <= chars_per_row).alias("n"), F.min("chars").alias("least"))
    counts = staged(counts.select(F.col("lang").alias("l"), "n", "least"), "langid-counts")
    place = F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    few = F.col("chars") <= F.greatest(F.col("least"), F.lit(chars_per_row))
    rows = known.where(F.col("text").rlike("\\p{L}")).join(counts, F.col("lang") == F.col("l")).where(few & (place < F.lit(rows_per_lang) / F.greatest("n", F.lit(1))))
    rows = rows.groupBy("lang", "text").agg(F.min(place).alias("place")).toPandas()
    out = {}
    for lang, g in rows.sort_values(["lang", "place", "text"]).groupby("lang"):
        taken, chars = [], 0
        for text in g.text:
            if chars >= chars_per_lang or (taken and chars + len(text) > 2 * chars_per_lang):
                break
            taken.append(text)
            chars += len(text)
        out[lang] = " ".join(taken)
    return dict(sorted(out.items()))


def _predictor(texts: dict[str, str], sharpness: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(texts)
        table = alphabet(c for t in texts.values() for c in t.lower())
        automata = [automaton(symbols_of(texts[x], table), int(table.max()) + 1) for x in langs]
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                got: list[np.ndarray] = []
                chars = 0
                while at + len(got) < batch.num_rows and (not got or chars < BATCH_CHARS):
                    text = batch.column(1)[at + len(got)].as_py() or ""
                    got.append(symbols_of(text, table) if any(map(str.isalpha, text)) else np.zeros(0, np.int32))
                    chars += len(got[-1])
                best, score = np.full(len(got), len(langs)), np.zeros(len(got))
                if langs:
                    r = rates(got, automata)
                    empty = np.array([len(t) == 0 for t in got])
                    best = np.where(empty, len(langs), r.argmin(1))
                    # How far the others' parses are longer, taken over the phrases there are evidence for.
                    weight = np.exp(-sharpness * (r - r.min(1, keepdims=True)) * np.minimum(np.array([len(t) for t in got]), 400)[:, None])
                    score = np.where(empty, 0.0, 1.0 / weight.sum(1))
                columns = [batch.column(0)[at : at + len(got)], batch.column(2)[at : at + len(got)], pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])
                at += len(got)

    return predict


def identified(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_lang: int = 200, chars_per_row: int = 1000, chars_per_lang: int = 24_000, sharpness: float = 1.0,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: the language of every whole text.

    Per language a suffix automaton is built of labelled text of rows that are not ``held_out``: whole rows of a
    bounded sample (:func:`learned_texts`). Letters of every script that the sample holds are told apart. Each whole
    text is parsed, greedily, into longest matches of each automaton; the language that needs the fewest phrases per
    symbol wins, the first by name of equals. Very long texts are parsed in lanes of ``LANE`` symbols that carry
    the match on. ``score`` is the winner's share of ``exp(-sharpness * excess phrases)``.

    Null texts and texts without a letter are ``und`` with score 0, as everything is if no row is labelled.
    Null ids count as the empty text in the deal into folds. Repeated rows are kept, an empty table gives an
    empty result, extra columns are not read; labels, sources and ids are no inputs of a prediction.
    """
    texts = learned_texts(docs, ~held_out, lang_col, text_col, id_col, rows_per_lang, chars_per_row, chars_per_lang)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_predictor(texts, sharpness), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
