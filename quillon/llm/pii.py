"""Personal data and what reveals it: patterns, then information-theoretic sanitisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import skew_join, whole
from quillon.staging import staged

KINDS = ("email", "ip", "card", "phone")
#: Words of letters of any script, of three at least; the same pattern serves Python and Spark.
TERM = r"\p{L}{3,}"

#: So many revealing terms go along with the tasks; of more, all terms of the texts are joined to them.
KNOWN_TERMS = 200_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of these never ends within digits that go on, so none begins there: the look-behind only saves work.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = regex.compile(TERM)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and domain, found from each ``@``: linear however long a run is."""
    out, begin = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > begin and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            out.append((start, domain.end()))
            begin = domain.end()
        else:
            begin = at + 1
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the base patterns, by kind and start; failing matches are dropped without a retry."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """The name under which occurrences of one protected value are counted together."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """``term, start, end`` of the terms of the whole text outside all spans."""
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    at = 0
    for m in _TERM.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or m.end() <= covered[at][0]:
            yield m[0].lower(), *m.span()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entities, terms = [], []
        for text in batch.column(1):
            text = text.as_py()
            spans = base_spans(text)
            entities.append(sorted({entity(kind, text[a:b]) for kind, a, b in spans}))
            terms.append(sorted({t for t, _, _ in free_terms(text, spans)}) if spans else [])
        columns = [pa.array(c, pa.list_(pa.string())) for c in (entities, terms)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "entities", "terms"])


def met(docs: DataFrame, text_col: str) -> DataFrame:
    """``row, entities, terms`` of every row: distinct, of the whole text; texts without an entity give no terms."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), whole(text_col).alias("text"))
    return rows.mapInArrow(_met, "row long, entities array<string>, terms array<string>")


_BASE = "n_email long, n_ip long, n_card long, n_phone long, base string"
_MET = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TERMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64()), ("action", pa.string())]))


def _found(known: dict[str, float] | None, removal: float):
    names = ["row", "doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "base", "met" if known is None else "terms"]
    types = [pa.int64()] * 4 + [pa.string(), _MET if known is None else _TERMS]

    def marked(text: str, spans: list[tuple[str, int, int]]) -> list[dict] | None:
        if known is None:
            return [{"term": t, "start": a, "end": b} for t, a, b in free_terms(text, spans)]
        if known.keys().isdisjoint(t.lower() for t in set(_TERM.findall(text))):
            return None
        hits = [(a, b, known[t]) for t, a, b in free_terms(text, spans) if t in known]
        return [{"start": a, "end": b, "disclosure": d, "action": "remove" if d >= removal else "generalise"} for a, b, d in hits] or None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                text = text.as_py()
                spans = base_spans(text)
                line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                rows.append([*(sum(k == s[0] for s in spans) for k in KINDS), line, marked(text, spans)])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return find


def found_base(docs: DataFrame, id_col: str, text_col: str, known: dict[str, float] | None, removal: float) -> DataFrame:
    """Every row with its base spans, and in ``terms`` the ``known`` revealing terms (if None, in ``met`` all terms)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    last = "met array<struct<term:string,start:int,end:int>>" if known is None else "terms array<struct<start:int,end:int,disclosure:double,action:string>>"
    return rows.mapInArrow(_found(known, removal), f"row long, doc_id {kind}, text string, {_BASE}, {last}")


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``term, n_term``: the number of rows whose whole text has the term."""
    terms = F.array_distinct(F.regexp_extract_all(whole(text_col), F.lit(TERM), F.lit(0)))
    terms = F.array_distinct(F.transform(terms, F.lower))  # cut first, as Python does: some capitals become two characters
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def together(rows: DataFrame, entities: DataFrame, counts: DataFrame, n_rows: int, share: float, support: int) -> DataFrame:
    """``row, entity, term`` of the pairs of a whole text that may reveal, from the rows of :func:`met`.

    Nothing that could reveal is left out: both sides of a pair are in ``support`` rows at least, and as a pair
    is met at most as often as its entity, the disclosure falls short where the term is in over
    ``n_entity**share * n_rows**(1 - share)`` rows. Terms that are too frequent for every entity go before the pairs.
    """
    entities = entities.where(F.col("n_entity") >= support)
    bound = F.when(F.col("n_entity") < n_rows, F.pow(F.col("n_entity").cast("double"), F.lit(share)) * F.lit(float(max(n_rows, 1)) ** (1 - share)) * (1 + 1e-9))
    bound = F.coalesce(bound, F.lit(float("inf")))
    entities = staged(entities.withColumn("bound", bound), "pii-entities")
    most = entities.agg(F.max("bound")).first()[0] or 0.0
    kept = counts.where((F.col("n_term") >= support) & (F.col("n_term") <= most))
    terms = skew_join(rows.select("row", F.explode("terms").alias("term")), kept, "term")
    named = skew_join(rows.select("row", F.explode("entities").alias("entity")), entities, "entity")
    named = named.select(F.col("row").alias("e_row"), "entity", "bound")
    return terms.join(named, (F.col("row") == F.col("e_row")) & (F.col("n_term") <= F.col("bound"))).select("row", "entity", "term")


def revealing(near: DataFrame, counts: DataFrame, n_rows: int, share: float, support: int, entities: DataFrame | None = None) -> DataFrame:
    """``entity, term, disclosure``: pairs of which the term gives away at least ``share`` of the entity's information.

    ``near`` holds ``row, entity, term``; ``entities`` the rows of each entity (``n_entity``), else counted in ``near``. Disclosure is the pointwise mutual information of term and entity,
    estimated from numbers of rows over the whole corpus, divided by the entity's own information; 1 if the
    term occurs nowhere but with the entity. Pairs met in fewer than ``support`` rows are no evidence.
    """
    pairs = near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = staged(pairs.where(F.col("n_both") >= support), "pii-pairs")
    if entities is None:
        entities = near.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = skew_join(skew_join(pairs, entities, "entity"), counts, "term")  # a term that is not counted is no evidence
    mutual = F.log(F.col("n_both") * F.lit(float(n_rows)) / (F.greatest("n_term", "n_both") * F.col("n_entity")))
    own = -F.log(F.col("n_entity") / F.lit(float(n_rows)))
    return both.withColumn("disclosure", F.when(own > 0, mutual / own).otherwise(0.0)).where(F.col("disclosure") >= share).select("entity", "term", "disclosure")


def _detected(docs: DataFrame, id_col: str, text_col: str, share: float, removal: float, support: int) -> DataFrame:
    """The columns of :func:`detected` and ``text``."""
    rows = staged(met(docs, text_col), "pii-met")
    n_rows = rows.count()
    entities = staged(rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "pii-counts")
    counts = staged(term_counts(docs, text_col), "pii-terms")
    pairs = revealing(together(rows, entities, counts, n_rows, share, support), counts, n_rows, share, support, entities)
    terms = staged(pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-revealing")
    if terms.limit(KNOWN_TERMS + 1).count() <= KNOWN_TERMS:
        return found_base(docs, id_col, text_col, {r.term: r.disclosure for r in terms.toLocalIterator()}, removal)
    found = staged(found_base(docs, id_col, text_col, None, removal), "pii-base")
    hits = skew_join(found.select("row", F.explode("met").alias("m")).select("row", "m.*"), terms, "term")
    action = F.when(F.col("disclosure") >= removal, "remove").otherwise("generalise").alias("action")
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure", action))).alias("terms"))
    return found.drop("met").join(spans, "row", "left")


def detected(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    share: float = 0.8, removal: float = 0.95, support: int = 3,
) -> DataFrame:
    """``row, doc_id, n_email, n_ip, n_card, n_phone, base, terms`` of every row.

    ``base`` lists the spans of the base patterns as ``kind:start:end``; ``terms`` the spans (``start, end,
    disclosure, action``) of all occurrences of terms that reveal a protected value, by co-occurrence in whole
    texts over the whole corpus: from ``share`` of its information on they are to be generalised, from
    ``removal`` on removed. A term that reveals one value is marked in every text, with or without the value,
    with its greatest disclosure. Null texts count as empty; repeated rows are counted and returned apart; an
    empty table gives an empty result; extra columns are not read. A very long text is searched whole, by one task,
    in time that grows with its length alone.
    """
    return _detected(docs, id_col, text_col, share, removal, support).drop("text")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``doc_id, text`` with base spans replaced by their kind, terms that reveal them generalised or removed.

    Every row keeps its own spans, whatever id it shares; null texts come back empty; else as :func:`detected`.
    """
    options = {"share": 0.8, "removal": 0.95, "support": 3, **options}
    found = _detected(docs, id_col, text_col, **options)
    terms = F.transform("terms", lambda t: F.concat_ws(":", t["action"], t["start"], t["end"])).alias("terms")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                spans = [(int(a), int(b), f"[{kind}]") for kind, a, b in (x.split(":") for x in (base.as_py() or "").split(",") if x)]
                spans += [(int(a), int(b), "" if kind == "remove" else "[term]") for kind, a, b in (x.split(":") for x in terms.as_py() or [])]
                done, at = [], 0
                for a, b, new in sorted(spans):
                    if a >= at:
                        done += [text.as_py()[at:a], new]
                        at = b
                out.append("".join(done) + text.as_py()[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.select("doc_id", "text", "base", terms).mapInArrow(clean, f"doc_id {kind}, text string")
