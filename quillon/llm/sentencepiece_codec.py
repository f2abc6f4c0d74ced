"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, and decoding."""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import give_back, lean, whole

META = "▁"
#: Parts remembered per task, their characters in all, and the longest that is remembered: about 60 MB, as only packed ids are kept.
CACHE_WORDS, CACHE_CHARS, CACHE_LONGEST = 250_000, 3_000_000, 100
#: normalizer_spec { add_dummy_prefix: false }, as a message to merge into a model's.
NO_PREFIX = b"\x1a\x02\x18\x00"
#: Parts of so many characters are merged together with others of their length.
SHORT = 40
#: Characters the library is given at once.
BATCH_CHARS = 500_000


class Agenda:
    """Encoder for a merge-type vocabulary with byte fallback and no normalisation but the white-space escape."""

    def __init__(self, model_file: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:  # the same model without the space mark before a text, for parts of texts
            self.exact = sentencepiece.SentencePieceProcessor(model_proto=f.read() + NO_PREFIX)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # Characters outside every longer piece never merge; and no piece goes on from another character
        # into a space mark. So a text falls apart there and each part can be encoded alone.
        merging = {c for p in self.ids if len(p) > 1 for c in p} | {META}
        if any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("pieces of this vocabulary span words")
        inner = "".join(re.escape(c) for c in sorted(merging - {META}))
        self.parts = re.compile(f"{META}+[{inner}]*|[{inner}]+|.", re.DOTALL).findall
        # Symbols by number, first the characters that merge; and for each pair that is a piece its number and score.
        self.symbols = list(dict.fromkeys([*sorted(merging), *self.scores]))
        number = {s: i for i, s in enumerate(self.symbols)}
        self.number_of = np.full(sys.maxunicode + 1, -1, np.int32)
        self.number_of[[ord(c) for c in merging]] = [number[c] for c in merging]
        pairs = {}
        for piece, score in self.scores.items():
            for i in range(1, len(piece)):
                left, right = number.get(piece[:i]), number.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * len(number) + right] = (number[piece], score)
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.pair_scores = np.array([pairs[k][1] for k in self.keys.tolist()])
        self.id_of = np.array([self.ids.get(s, -1) for s in self.symbols])
        self.decimals = [str(i) for i in range(n)]
        self.seen: dict[str, bytes] = {}  # ids of four bytes each
        self.chars = 0
        self.long: list[str] = []

    def merge(self, part: str) -> tuple[int, ...]:
        """Join the adjacent pair whose piece scores highest, the leftmost of equals, until no pair is a piece."""
        return self.merge_all([part])[0]

    def merge_all(self, parts: list[str]) -> list[tuple[int, ...]]:
        """:meth:`merge` of each part; those of one length advance together."""
        out: list[tuple[int, ...]] = [()] * len(parts)
        by_length: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            if 1 < len(part) <= SHORT:
                by_length.setdefault(len(part), []).append(i)
            else:
                out[i] = self.ids_of(self.merge_long(part))
        for same in by_length.values():
            for at, rows in self.merge_equal([parts[i] for i in same]):
                ids = self.id_of[rows]
                for k, row, known, of in zip(at.tolist(), ids.tolist(), (ids >= 0).all(1).tolist(), rows, strict=True):
                    out[same[k]] = tuple(row) if known else self.ids_of([self.symbols[x] for x in of])
        return out

    def merge_equal(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The agendas of parts of one length, one join a step: numbers of the parts that are done, and their symbols.

        The agenda of a part is a row of its pairs' scores. Every part that is not done loses one symbol a step, so the
        rows stay equally long.
        """
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(parts), -1)
        symbols = self.number_of[codes]
        joined, agenda = self.pairs(symbols[:, :-1], symbols[:, 1:])
        at = np.arange(len(parts))
        while len(at):
            width = agenda.shape[1]
            best = agenda.argmax(1) if width else np.zeros(len(at), np.int64)
            row = np.arange(len(at))
            more = agenda[row, best] > -np.inf if width else np.zeros(len(at), bool)
            if not more.all():
                yield at[~more], symbols[~more]
                at, symbols, joined, agenda, best = at[more], symbols[more], joined[more], agenda[more], best[more]
                row = np.arange(len(at))
            if not len(at):
                return
            symbols[row, best] = joined[row, best]
            columns = np.arange(width)
            symbols = symbols[row[:, None], columns + (columns > best[:, None])]
            columns = columns[:-1] + (columns[:-1] >= best[:, None])
            joined, agenda = joined[row[:, None], columns], agenda[row[:, None], columns]
            for r, b in ((row[best > 0], best[best > 0] - 1), (row[best < width - 1], best[best < width - 1])):
                joined[r, b], agenda[r, b] = self.pairs(symbols[r, b], symbols[r, b + 1])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What two symbols join to, and its score; minus infinity where that is no piece."""
        wanted = left.astype(np.int64) * len(self.symbols) + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.joined[at], np.where(self.keys[at] == wanted, self.pair_scores[at], -np.inf)

    def ids_of(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            out += [known] if known is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def merge_short(self, part: str) -> list[str]:
        """One part by :meth:`merge_equal`, as texts."""
        return [self.symbols[x] for _, rows in self.merge_equal([part]) for x in rows[0]] if len(part) > 1 else [part]

    def merge_long(self, part: str) -> list[str]:
        """The agenda as a heap, whose entries for symbols that have changed are passed over."""
        symbols: list[str | None] = list(part)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, str]] = []
        scores = self.scores

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            score = scores.get(piece)
            if score is not None:
                heapq.heappush(agenda, (-score, i, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            if symbols[i] is None or (j := right[i]) >= n or symbols[i] + symbols[j] != piece or len(symbols[i]) == len(piece):
                continue
            symbols[i], symbols[j] = piece, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s is not None]

    def split(self, text: str) -> list[str]:
        return self.parts(META + text.replace(" ", META)) if text else []

    def learn(self, texts: list[list[str]]) -> set[str]:
        """Merge the parts of split ``texts`` that are not known yet, check them against the library in one batch.

        Returns the parts on which the two differ; for those the library's ids are kept. Where too many are remembered, only
        those of ``texts`` stay.
        """
        seen = self.seen
        for part in self.long:
            seen.pop(part, None)
        wanted = set(chain.from_iterable(texts))
        new = list(wanted.difference(seen))
        if len(seen) + len(new) > CACHE_WORDS or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.seen = seen = {part: seen[part] for part in wanted if part in seen}
            self.chars = sum(map(len, seen))
        differ = set()
        for part, mine, theirs in zip(new, self.merge_all(new), self.exact.encode(new, num_threads=1) if new else [], strict=True):
            if mine != tuple(theirs):
                differ.add(part)
                mine = tuple(theirs)
            seen[part] = struct.pack(f"{len(mine)}i", *mine)
        self.long = [part for part in new if len(part) > CACHE_LONGEST]
        self.chars += sum(map(len, new)) - sum(map(len, self.long))
        return differ

    def encode(self, parts: list[str]) -> tuple[list[int], str]:
        """The ids of a split text whose parts are learned, and their decimals joined by commas."""
        ids = np.frombuffer(b"".join([self.seen[p] for p in parts]), np.int32).tolist()
        return ids, ",".join([self.decimals[i] for i in ids])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _coder(model_file: str, texts_out: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = Agenda(model_file)
        gc.disable()  # the remembered words hold no cycles; walking through them again and again is most of the cost
        try:
            yield from lean(lambda batch: _coded(agenda, batch, texts_out))(batches)
        finally:
            agenda.seen.clear()
            agenda.long.clear()
            gc.enable()
            gc.collect()  # a worker that waits for its next task holds no words
            del agenda
            give_back()

    return code


def _coded(agenda: Agenda, batch: pa.RecordBatch, texts_out: bool) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        texts: list[str] = []
        chars = 0
        while at + len(texts) < batch.num_rows and (not texts or chars < BATCH_CHARS):
            texts.append(batch.column(1)[at + len(texts)].as_py())
            chars += len(texts[-1])
        parts = [agenda.split(t) for t in texts]
        differ = agenda.learn(parts)
        mine = [agenda.encode(p) for p in parts]
        agree = [not differ or differ.isdisjoint(p) for p in parts]
        decoded = [agenda.library.decode(ids) for ids, _ in mine]
        columns = [
            batch.column(0)[at : at + len(texts)],
            pa.array([len(ids) for ids, _ in mine], pa.int64()),
            pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in mine]),
            pa.array([_sha(d) for d in decoded]),
            pa.array(agree),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agenda_agrees"]
        if texts_out:
            columns += [pa.array([ids for ids, _ in mine], pa.list_(pa.int32())), pa.array(decoded)]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)
        at += len(texts)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, texts_out: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: ``doc_id, n_tokens, ids_sha256, decoded_sha256, agenda_agrees``.

    With ``texts_out`` also ``ids`` and ``decoded``. No begin or end ids, no sampling. In each batch the parts
    not met before are checked against the library: where the agenda differs from it, ``agenda_agrees`` is
    false and the library's ids are returned. Null texts count as empty: no ids, empty decoded text. Repeated rows and null ids are
    kept, an empty table gives an empty result, extra columns are not read. A very long text is split and merged as a
    whole, in one task; its parts of over ``CACHE_LONGEST`` characters are forgotten with the batch.

    The model file must be at the same place on all executors, as an installed vocabulary package is.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agenda_agrees boolean"
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(_coder(model_file or default_model(), texts_out), schema + (", ids array<int>, decoded string" if texts_out else ""))
