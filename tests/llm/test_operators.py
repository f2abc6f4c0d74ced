import ctypes
import gc
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, langid, mixing, ogg, pii, quality, sentencepiece_codec, simhash, suffix_dedup, warc
from quillon.llm.common import lean, remainder
from tests.llm.conftest import AWKWARD

SPACES = re.compile(r"[\x20\x09-\x0D]")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# 1 ---------------------------------------------------------------------------------------------------


def brute_repeats(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i + 1 : i + size + 1] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])), sha(kept)))
    return out


@pytest.mark.parametrize("hot", [3000, 1, 4])
def test_suffix_dedup(spark, prose, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [*prose, None, "", "é" * 99, "é" * 100, "é" * 101, "z" * 1500, prose[0], prose[0]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats_removed(texts_df(spark, texts)).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    assert any(r[1] for r in got.values()) and any(not r[1] for r in got.values())


def test_suffix_dedup_awkward(awkward, empty):
    rows = suffix_dedup.repeats_removed(awkward, keep_text=True).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert (by[3].n_bytes, by[3].n_removed, by[3].kept_sha256) == (0, 0, sha(b""))
    assert by[9].n_removed == 60_000 and bytes(by[9].kept) == b""
    assert by[1].n_removed == 0
    assert suffix_dedup.repeats_removed(empty).count() == 0


def test_suffix_samples_cover_equal_strings():
    data = np.frombuffer(b"abcdefgh" * 3 + bytes(range(256)) * 3 + b"q" * 300, np.uint8)
    at, name, first, last = suffix_dedup.samples(data, 200)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((first <= at) & (at <= first + 168)).all()
    long = np.frombuffer(np.random.default_rng(1).bytes(10_000), np.uint8)
    assert (suffix_dedup.names(long, 200)[5000] == suffix_dedup.names(long[5000:5200], 200)).all()


def test_suffix_order():
    from quillon.llm.suffix_array import suffix_order

    rng = np.random.default_rng(0)
    for _ in range(2000):
        a = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 40)))
        b = bytes(a.astype(np.uint8))
        assert suffix_order(a).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    a = rng.integers(1, 3, 5000)
    a[2500:] = a[:2500]
    b = bytes(a.astype(np.uint8))
    assert suffix_order(a).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert suffix_order(np.ones(9999, int)).tolist() == list(range(9998, -1, -1))


@pytest.mark.parametrize("length", [33, 40, 200])
def test_suffix_repeated_starts(length):
    """Against all strings of the cuts, in a text of few letters with copied stretches."""
    from quillon.llm.suffix_array import repeated_starts

    rng = np.random.default_rng(length)
    cuts = [rng.integers(97, 99, int(rng.integers(1, 500))).astype(np.uint8).tobytes() for _ in range(60)]
    for i in range(0, 60, 3):
        a = int(rng.integers(0, 100))
        cuts[i] = cuts[i][:50] + cuts[i - 1][a : a + int(rng.integers(length - 2, length + 40))] + cuts[i][50:]
    cuts += [b"z" * 300, b"z" * (length - 1), cuts[5][:length]]
    seen = Counter(c[i : i + length] for c in cuts for i in range(len(c) - length + 1))
    want = [(k, i) for k, c in enumerate(cuts) for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1]
    assert [tuple(x) for x in repeated_starts(cuts, length).T.tolist()] == want and want


def test_suffix_names_decide_nothing(monkeypatch):
    """Cuts that share a name by chance have only their equal bytes in common; long texts are sampled window by window."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    cuts = [rng.bytes(300) for _ in range(6)]
    cuts += [cuts[0][40:270] + cuts[1][:60], cuts[2]]
    schema = ["t1", "t2", "name", "first", "bytes"]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i in range(8)]), pa.array([0] * 8), pa.array([77] * 8), pa.array([1000] * 8), pa.array(cuts, pa.binary())], schema)
    got = sorted(tuple(r.values()) for b in suffix_dedup._compared(200)(iter([batch])) for r in b.to_pylist())
    assert got == [(0, 0, 1040, 1270), (2, 0, 1000, 1300), (6, 0, 1000, 1230), (7, 0, 1000, 1300)]
    data = np.frombuffer(rng.bytes(5000), np.uint8)
    whole = {(int(p), int(f), int(e)) for p, _, f, e in zip(*suffix_dedup.samples(data, 200), strict=True)}
    monkeypatch.setattr(suffix_dedup, "WINDOW", 700)
    parts = [x for a in suffix_dedup.windowed_samples(data, 200) for x in zip(*(c.tolist() for c in a), strict=True)]
    assert [f for _, _, f, _ in parts] == [0, *[e + 1 for *_, e in parts[:-1]]] and parts[-1][3] == 4800
    assert {p for p, *_ in parts} == {p for p, *_ in whole}


# 2 ---------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[root(i)].append(ids[i])
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("refine", [1 << 40, 0])
def test_simhash_links(spark, monkeypatch, refine):
    """Fingerprints in chains and crowded buckets, so that links beyond the buckets' ends count."""
    monkeypatch.setattr(simhash, "REFINE_ABOVE", refine)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in fps[:12]:
        for _ in range(25):
            g = f
            for b in rng.integers(0, 64, int(rng.integers(1, 8))):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - ((f >> 63) << 64),) for f in fps], "fp long")
    got = {r.fp & (2**64 - 1): r.component & (2**64 - 1) for r in simhash.linked(df).collect()}
    want = reached(fps, fps)
    groups = defaultdict(set)
    for f, w in zip(fps, want, strict=True):
        groups[w].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[got.get(f, f)].add(f)
    assert {frozenset(g) for g in mine.values()} == {frozenset(g) for g in groups.values()}


def test_simhash_buckets(spark, monkeypatch):
    """Members that share a whole segment are listed once for it, not for each of its wildcards; nothing is broadcast."""
    seen = {}

    def kept(df, name="stage", codec=None, write=simhash.staged):
        seen[name] = "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        out = write(df, name, codec)
        if name == "simhash-buckets":
            seen["rows"] = out.count()
        return out

    monkeypatch.setattr(simhash, "staged", kept)
    rng = np.random.default_rng(3)
    far = (rng.integers(0, 1 << 40, 50, dtype=np.int64) << 22) | 12345
    one = far[:1] ^ 1  # differs in a wildcard of the shared segment
    want = {int(x) for x in (far[0], one[0])}
    got = simhash.linked(spark.createDataFrame([(int(x),) for x in [*far, *one]], "fp long"))
    assert {r.fp for r in got.collect()} == want
    assert 50 <= seen.pop("rows") <= 50 + 51 + 2 * 64
    assert all(seen.values()), seen


def test_simhash(spark, prose, awkward, empty):
    texts = [*prose, *prose[:3]]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(texts_df(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, reached(list(range(len(fps))), fps), strict=True))}
    rows = simhash.near_duplicates(awkward).collect()
    ids, fps = [a[0] for a in AWKWARD], [fingerprint(a[1]) for a in AWKWARD]
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, reached(ids, fps), strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.simhash_dedup(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 6}
    assert not {2, 7, 4, 5} & {r.doc_id for r in kept.collect()}


# 3 ---------------------------------------------------------------------------------------------------


def test_ogg(spark, awkward, empty):
    rows = ogg.read_back(ogg.store(awkward)).collect()
    assert len(rows) == len(AWKWARD) and all(r.error is None for r in rows)
    for r in rows:
        raw = next((t or "").encode() for i, t, *_ in AWKWARD if i == r.doc_id)
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    assert ogg.read_back(ogg.store(empty)).count() == 0
    assert ogg.measure(None)["error"]


def test_ogg_container():
    assert ogg.page_crc(b"123456789") == 0x89A1897F  # the CRC-32 of this polynomial without reflection and inversion
    rng = np.random.default_rng(3)
    for n in (64, 6016, 255 * 64, 510 * 64, 200_000 // 64 * 64):
        payload = rng.bytes(n)
        media = ogg.encode(payload, n - 3)
        got = ogg.decode(media)
        assert (got["payload"], got["n_bytes"], got["times"][0]) == (payload, n - 3, 0.0)
        assert got["times"] == [i / ogg.RATE for i in range(0, n, ogg.PACKET)]
        for at in rng.integers(0, len(media), 5):
            broken = bytearray(media)
            broken[at] ^= 4
            assert ogg.measure(bytes(broken))["error"]
        assert ogg.measure(media[:-1])["error"]
    streams = ogg.demultiplex(media)
    assert set(streams) == {ogg.SAMPLES, ogg.LEVELS} and streams[ogg.SAMPLES]["pages"] > 2


# 4 ---------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_patterns():
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("a.@-+ 1234()%é0") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += [t or "" for _, t, *_ in AWKWARD] + ["a" * 50_000, "1" * 50_000, "+1" * 9000, "1." * 20_000, "a@" * 9000, "a@b.c@d.e", "x@y.z.@q.r", "4532015112830366 378282246310005"]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)


def test_pii_terms(spark, awkward, empty):
    """A rare name that only stands with one address is a term; common words, and words of clean texts, are not."""
    texts = [f"please write to Zebulon under zeb@corp.example about order number {i}" for i in range(4)]
    texts += [f"please write about order number {i} under the usual address" for i in range(60)] + ["Mnemosyne stands alone"]
    found = {r.doc_id: r for r in pii.detected(texts_df(spark, texts)).collect()}
    for i in range(4):
        terms = {texts[i][t.start : t.end]: t for t in found[i].terms}
        assert "Zebulon" in terms and not {"please", "write", "order", "under"} & set(terms)
        assert terms["Zebulon"].disclosure == pytest.approx(1.0) and terms["Zebulon"].action == "remove"
        assert found[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[i]))
    assert all(found[i].terms is None for i in range(4, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitised(texts_df(spark, texts)).collect()}
    assert clean[0] == "please write to  under [email] about order number 0" and clean[64] == texts[64]
    rows = pii.detected(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(next(t or "" for i, t, *_ in AWKWARD if i == r.doc_id))) for r in rows)
    assert next((r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows if r.doc_id == 10) == (1, 1, 1, 1)
    assert pii.detected(empty).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_whole_texts(spark, monkeypatch, most):
    """A revealing term counts however far from the value it stands, and is marked wherever it stands."""
    monkeypatch.setattr(pii, "KNOWN_TERMS", most)
    far = " ".join(f"filler{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 3)
    texts = [f"Zebulon {far} write to zeb@corp.example {far} Zebulon" for _ in range(9)] + ["Zebulon alone"] + [far] * 190
    rows = [(i if i % 2 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detected(docs, share=0.8).select("n_email", "terms").collect()
    marked = [r for r in found if r.terms]
    assert len(found) == 200 and len(marked) == 10
    by_value = {True: [], False: []}
    for r in marked:
        by_value[r.n_email == 1].append([(t.start, t.end) for t in r.terms])
    ends = [(m.start(), m.end()) for m in re.finditer("Zebulon", texts[0])]
    write = texts[0].index("write")
    assert by_value[True] == [sorted([*ends, (write, write + 5)])] * 9 and by_value[False] == [[(0, 7)]]
    entity, n = 9, 200
    z = next(t.disclosure for r in marked if r.n_email == 0 for t in r.terms)
    assert z == pytest.approx(np.log(9 * n / (10 * entity)) / np.log(n / entity))
    clean = Counter(r.text for r in pii.sanitised(docs).collect())
    assert sum(n for t, n in clean.items() if "Zebulon" in t or "@" in t) == 0 and clean[far] == 190


def brute_terms(texts, share=0.8, removal=0.95, support=3):
    """``start, end, action`` per text by counting everything in Python; a term is a run of three letters at least."""
    import math

    def entities(text):
        return {(k, text[a:b].lower() if k == "email" else text[a:b] if k == "ip" else re.sub("[^0-9]", "", text[a:b])) for k, a, b in brute_spans(text)}

    def terms(text, free):
        covered = [(a, b) for _, a, b in brute_spans(text)] if free else []
        runs = re.finditer(r"[^\W\d_]+", text)
        return [(m[0].lower(), *m.span()) for m in runs if len(m[0]) >= 3 and not any(a < m.end() and m.start() < b for a, b in covered)]

    n_entity, n_term, n_both = Counter(), Counter(), Counter()
    for text in texts:
        es, ts = entities(text), {t for t, *_ in terms(text, True)}
        n_entity.update(es)
        n_term.update({t for t, *_ in terms(text, False)})
        n_both.update((e, t) for e in es for t in ts)
    known = {}
    for (e, t), both in n_both.items():
        if both >= support and n_entity[e] < len(texts):
            d = math.log(both * len(texts) / (n_term[t] * n_entity[e])) / -math.log(n_entity[e] / len(texts))
            if d >= share:
                known[t] = max(known.get(t, 0), d)
    return [[(a, b, "remove" if known[t] >= removal else "generalise") for t, a, b in terms(text, True) if t in known] for text in texts]


def test_pii_query(spark, tmp_path, prose):
    """The query's whole result against patterns and counts in Python, terms of other scripts and capitals included."""
    from quillon.llm.queries import op4_pii

    texts = [f"{name} wohnt bei {mail} {prose[i]}" for i, (name, mail) in enumerate([("Сергей", "s@corp.example"), ("李小龙先生", "10.1.2.3"), ("İstanbul", "+49 (30) 1234567"), ("Zoë", "4532 0151 1283 0366")] * 8)]
    texts += [f"{prose[i]} İSTANBUL" for i in range(30)] + prose + [None, "", "Сергей один", "x" * 50_000 + " a@b.c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op4_pii(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    want = brute_terms(plain)
    assert {plain[i][a:b] for i, found in enumerate(want) for a, b, _ in found} >= {"Сергей", "李小龙先生", "Zoë"}
    for i, text in enumerate(plain):
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(text)]
        assert rows[i].base_sha256 == sha(",".join(base))
        assert rows[i].spans == ",".join([*base, *(f"term:{a}:{b}" for a, b, _ in want[i])])
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(b.startswith(k) for b in base) for k in PATTERNS]


def test_pii_sanitised_rows(spark):
    """Rows of null and of repeated ids keep their own spans."""
    texts = ["mail a@b.example now", "card 4532 0151 1283 0366 here", "call +1 555 010 9999", "nothing at all"]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in pii.sanitised(docs).collect())
    clean = ["mail [email] now", "card [card] here", "call [phone]", "nothing at all"]
    assert got == Counter((i, t) for i in (None, 7) for t in clean)


def test_pii_disclosure(spark):
    near = spark.createDataFrame([(r, "e", t) for r in range(3) for t in ("x", "y")] + [(9, "f", "y")], "row long, entity string, term string")
    counts = spark.createDataFrame([("x", 3), ("y", 50)], "term string, n_term long")
    got = {(r.entity, r.term): r.disclosure for r in pii.revealing(near, counts, 100, -10.0, 3).collect()}
    own = -np.log(3 / 100)
    assert got == {("e", "x"): pytest.approx(np.log(3 * 100 / (3 * 3)) / own), ("e", "y"): pytest.approx(np.log(3 * 100 / (50 * 3)) / own)}


# 5 ---------------------------------------------------------------------------------------------------


def test_warc(spark):
    pages = [(1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c/%0A\n", None), (4, "http://d/", ""), (5, "http://e/", "é" * 30_000), (None, "http://n/", "<p>one</p>"), (None, "http://m/", "lonely"), (6, "http://d/", "x\r\n\r\ny"), (6, "http://d/", "x\r\n\r\ny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("file", "offset", "same", "keep_id", "payload")})
    index, folder = warc.write_archives(df)
    assert index.count() == len(pages)
    rows = warc.read_records(index, folder).collect()
    keep = defaultdict(list)
    for i, _, h in pages:
        keep[h or ""].append(i)
    want = []
    for i, u, h in pages:
        raw, best = (h or "").encode(), max((x for x in keep[h or ""] if x is not None), default=None)
        back = best is not None and best != i
        want.append((i, u, len(raw), warc.digest32(raw), "revisit" if back else "response", best if back else None, None if back else raw))
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in rows) == Counter(want)
    one = warc.read_records(index.where("page_id = 5"), folder).collect()  # a selection is read by its range alone
    assert [bytes(r.payload) for r in one] == ["é".encode() * 30_000]
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_damage():
    raw = warc.record(7, "http://x", b"payload", warc.digest32(b"payload"), None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"payload"
    for broken in (raw[:-6], raw.replace(b"payload\r\n", b"pAyload\r\n"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(broken)


# 6 ---------------------------------------------------------------------------------------------------


def brute_phrases(text, reference):
    """Longest matches, one symbol at a time."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in reference:
            end += 1
        n += 1
        at = max(at + 1, end - 1)
    return n


def test_cross_parsing():
    import random

    rng = random.Random(2)
    reference = "".join(rng.choice("abc ") for _ in range(400))
    nexts = langid.automaton(langid.symbols_of(reference))
    ref = "".join(map(chr, langid.symbols_of(reference) + 100))
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (1, 2, 50, langid.LANE, 90, 3)]
    got = langid.rates([langid.symbols_of(t) for t in texts], [nexts])[:, 0]
    for t, g in zip(texts, got, strict=True):
        s = "".join(map(chr, langid.symbols_of(t) + 100))
        assert round(g * len(s)) == brute_phrases(s, ref)


def test_cross_parsing_of_long_texts():
    """Matches go on over the ends of lanes: whole texts against one symbol at a time, among them the learned text itself."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    reference = " ".join(rng.choice(words) for _ in range(900))
    texts = [reference, reference[100:3000], " ".join(rng.choice(words) for _ in range(1100)), "z" * 700, "ab" * 900, "a", "", reference[7:300] + "zz" + reference]
    nexts = langid.automaton(langid.symbols_of(reference))
    ref = "".join(map(chr, langid.symbols_of(reference) + 100))
    assert max(map(len, texts)) > 5000
    got = langid.rates([langid.symbols_of(t) for t in texts], [nexts])[:, 0]
    for t, g in zip(texts, got, strict=True):
        s = "".join(map(chr, langid.symbols_of(t) + 100))
        assert round(g * len(s)) == brute_phrases(s, ref)
    assert round(got[0] * len(ref)) == 1


def test_langid_scripts(spark):
    """Languages of one script beyond the Latin blocks are told apart; whole rows are learned from, copies once."""
    import random

    rng = random.Random(6)
    makes = {"ru": range(0x430, 0x450), "uk": [*range(0x430, 0x440), 0x454, 0x456, 0x457, 0x491], "ja": range(0x3041, 0x3080), "hi": range(0x915, 0x930)}
    words = {x: ["".join(chr(rng.choice(r)) for _ in range(rng.randrange(2, 7))) for _ in range(80)] for x, r in makes.items()}
    rows = [(4 * i + k, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(40) for k, x in enumerate(makes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identified(docs, F.lit(False)).join(docs, "doc_id").collect()
    assert len(found) == 160 and sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found)
    more = [(None, "копия копия", "ru")] * 50 + [(900, " ".join(words["ru"] * 40), "long")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    learned = langid.learned_texts(docs, F.lit(True), "lang", "text", "doc_id", 200, 1000, 3000)
    assert set(learned) == {*makes, "long"} and learned["ru"].count("копия копия") == 1 and learned["long"] == more[-1][1]
    assert all(3000 <= len(learned[x]) <= 6000 for x in makes)


def test_langid(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identified(docs, remainder("doc_id", 4) == 2)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    rows = langid.identified(awkward, remainder("doc_id", 4) == 2).collect()
    assert len(rows) == len(AWKWARD)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {3, 4, 5, 11} <= und and all(r.score == 0 for r in rows if r.lang_pred == "und") and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert langid.identified(empty, remainder("doc_id", 4) == 2).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled, F.lit(False)).collect()} == {"und"}


# 7 ---------------------------------------------------------------------------------------------------


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 5, None: 500, "e": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:  # deal out what is over, again and again
        left, w = total - sum(3 * sizes[k] for k in capped), sum(weight[k] for k in names if k not in capped)
        over = {k for k in names if k not in capped and left * weight[k] / w >= 3 * sizes[k]}
        if not over:
            break
        capped |= over
    assert got == {k: pytest.approx(3.0 * sizes[k] if k in capped else left * weight[k] / w) for k in names}


@pytest.mark.parametrize("slice_rows", [4000, 5])
def test_mixing(spark, prose, awkward, empty, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = spark.createDataFrame([(i, t, ["a", "b", "c", None][i % 7 % 4]) for i, t in enumerate(prose)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(prose) and sum(r.taken for r in rows) == sum(r.size for r in rows) == sum(len(t.split()) for t in prose)
    by = defaultdict(lambda: [0, 0.0, 0])
    source = {i: ["a", "b", "c", None][i % 7 % 4] for i in range(len(prose))}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        x = by[source[r.doc_id]]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, max(x[2], r.size)
    assert all(abs(taken - target) <= 2 * most + 1 for taken, target, most in by.values())
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mixed(docs.repartition(3)).collect()}
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.taken for r in rows if r.size == 0} == {0}
    assert mixing.mixed(empty).count() == 0


def brute_mix(rows, weights=(5, 2, 1), cap=3):
    """Words taken of each row ``(id, text, source)``, by one queue after another in Python."""
    size = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    words = {n: sum(z for z, (*_, s) in zip(size, rows, strict=True) if s == n) for n in names}
    weight, total, capped = {n: weights[i % len(weights)] for i, n in enumerate(names)}, sum(size), set()
    while True:
        left, w = total - sum(cap * words[k] for k in capped), sum(weight[k] for k in names if k not in capped)
        over = {k for k in names if k not in capped and left * weight[k] / w >= cap * words[k]}
        if not over:
            break
        capped |= over
    target = {k: float(cap * words[k]) if k in capped else left * weight[k] / w for k in names}
    often = Counter(i for (i, *_), z in zip(rows, size, strict=True) if z)
    queue = []
    for n in names:
        for p in range(min(cap, int(target[n] // max(words[n], 1)) + 1)):
            of = []
            for r, (i, _, s) in enumerate(rows):
                if s == n and size[r]:
                    again = f":{r}" if often[i] > 1 else ""
                    of.append((hashlib.md5(f"mix:{p}:{'' if i is None else i}{again}".encode()).hexdigest(), r))
            so_far = p * words[n]
            for digest, r in sorted(of):
                so_far += size[r]
                queue.append((so_far / target[n], digest, r))
    taken, left = [0] * len(rows), total
    for _, _, r in sorted(queue):
        part = max(0, min(size[r], left))
        taken[r], left = taken[r] + part, left - part
    return taken


@pytest.mark.parametrize("small", [False, True])
def test_mixing_queues(spark, prose, monkeypatch, small):
    """The whole mix against queues in Python; rows of null and of repeated ids are told apart by their number."""
    if small:
        for name, value in (("SLICE_ROWS", 3), ("RANGE_ROWS", 7), ("SUMS", 2), ("BROADCAST_SOURCES", 0)):
            monkeypatch.setattr(mixing, name, value)
    rows = [([None, 5, 1000 + i][i % 3], t, ["a", "b", None, "c", "b"][i % 5]) for i, t in enumerate(prose)] + [(None, None, "a"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = {r.row: r.taken for r in mixing.mixed(docs, row_col="n").collect()}
    assert got == dict(enumerate(brute_mix(rows)))


# 8 ---------------------------------------------------------------------------------------------------


def test_sentencepiece(spark, awkward, prose, empty):
    agenda = sentencepiece_codec.Agenda(sentencepiece_codec.default_model())
    texts = [t or "" for _, t, *_ in AWKWARD] + prose + ["", " ", "   a  b ", "\n\n x\ty", " ▁▁ a▁", "<s> </s> <unk> <0x0A>", " " * 3000 + "ab" * 3000, "a\x00b", "１２３ ａｂｃ", "é‍👩‍👩‍👧"]
    parts = [agenda.split(t) for t in texts]
    assert agenda.learn(parts) == set()
    assert [agenda.encode(p)[0] for p in parts] == agenda.library.encode(texts)
    for p in {p for ps in parts for p in ps}:  # both forms of the agenda
        assert agenda.merge_short(p) == agenda.merge_long(p) if len(p) < 300 else True
    rows = sentencepiece_codec.coded(awkward, texts_out=True).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        text = next(t or "" for i, t, *_ in AWKWARD if i == r.doc_id)
        ids = agenda.library.encode(text)
        assert r.agenda_agrees and list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(agenda.library.decode(ids)) and r.decoded == text
    assert sentencepiece_codec.coded(empty).count() == 0


def test_sentencepiece_forgets_long_parts():
    agenda = sentencepiece_codec.Agenda(sentencepiece_codec.default_model())
    for text in ("a" * 5000, "short words", "b" * 7000 + " tail"):
        parts = agenda.split(text)
        assert agenda.learn([parts]) == set() and agenda.encode(parts)[0] == agenda.library.encode(text)
    assert agenda.learn([[]]) == set() and max(map(len, agenda.seen)) <= sentencepiece_codec.CACHE_LONGEST
    assert agenda.chars == sum(map(len, agenda.seen))


def test_sentencepiece_remembers_little(monkeypatch):
    """A remembered part takes few bytes, and where there are too many only those of the texts in hand stay."""
    agenda = sentencepiece_codec.Agenda(sentencepiece_codec.default_model())
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(20_000)]
    texts = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
    gc.collect()
    tracemalloc.start()
    for text in texts:
        assert agenda.learn([agenda.split(text)]) == set()
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held / len(agenda.seen) < 300
    monkeypatch.setattr(sentencepiece_codec, "CACHE_WORDS", 1500)
    for text in [texts[3], texts[7] + " " + words[3001], texts[3]]:
        parts = agenda.split(text)
        assert agenda.learn([parts]) == set() and agenda.encode(parts)[0] == agenda.library.encode(text)
        assert len(agenda.seen) <= 2001 and agenda.chars == sum(map(len, agenda.seen))


def _anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_workers_hold_no_batch_and_give_memory_back():
    """While a task reads its next batch it holds none; what it freed has gone back to the system when it ends."""
    rng = random.Random(3)
    text = lambda i: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) if i % 4 == 0 else "plain" for _ in range(500))
    texts, base, held = [text(i) for i in range(1500)], [], []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - base[-1])
            yield pa.record_batch([pa.array(range(1500)), pa.array(texts)], ["doc_id", "text"])

    trim = ctypes.CDLL(None).malloc_trim
    for run in (sentencepiece_codec._coder(sentencepiece_codec.default_model(), False), lean(simhash._fingerprints)):
        base.append(pa.total_allocated_bytes())
        trim(0)
        assert sum(b.num_rows for b in run(batches())) == 4500
        assert max(held) < 2_000_000  # a batch has over 3 MB
        before = _anonymous_mb()
        trim(0)
        assert before - _anonymous_mb() < 10


def test_sentencepiece_query(spark):
    """The query's whole result against the library, and the agenda's own ids were right throughout."""
    from quillon.llm.queries import op8_sentencepiece

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = sentencepiece_codec.Agenda(sentencepiece_codec.default_model()).library
    rows = op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.agenda_agrees for r in rows)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# 9 ---------------------------------------------------------------------------------------------------


def test_quality(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder("doc_id", 5) == 0
    rows = quality.scored(docs, labels, held_out).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    bad = [r for r in rows if r.quality == 0]
    assert len(rows) > 500 and right > 0.98 and sum(r.predicted == 0 for r in bad) / len(bad) > 0.9
    few = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.scored(awkward, few, held_out).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.scored(empty, few, held_out).count() == 0
    none = quality.scored(awkward, few.where("quality = 0"), held_out).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.accepted(awkward, few, held_out).columns == awkward.columns


def test_quality_risk():
    """Positives against a mixture of known share: the non-negative risk finds the negatives without seeing one labelled."""
    rng = np.random.default_rng(4)
    positive = rng.normal(1, 0.7, (600, 3)).astype(np.float32)
    unlabelled = np.vstack([rng.normal(1, 0.7, (700, 3)), rng.normal(-1, 0.7, (300, 3))]).astype(np.float32)
    w = quality.fit(positive, unlabelled, 0.7)
    g = unlabelled @ w[:-1] + w[-1]
    assert ((g > 0) == (np.arange(1000) < 700)).mean() > 0.93


def test_quality_prior():
    """The share of positives in a mixture, from scores alone."""
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8):
        mixture = np.concatenate([rng.normal(3, 1, int(4000 * share)), rng.normal(-3, 1, 4000 - int(4000 * share))])
        assert quality.estimated_prior(rng.normal(3, 1, 3000), mixture) == pytest.approx(share, abs=0.06)


def test_quality_sample_of_hot_rows(spark):
    """Rows without an id, or of one id, are sampled like others, and equal ones once."""
    rows = [(None, f"text number {i}") for i in range(3000)] + [(7, f"another {i}") for i in range(3000)] + [(7, "the same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.sampled(docs, "doc_id", "text", len(rows), 900)
    assert 400 < len(got) < 800


# 10 --------------------------------------------------------------------------------------------------


def brute_exact(rows):
    norm = [SPACES.sub("", t or "") for _, t in rows]
    groups = defaultdict(list)
    for k, n in enumerate(norm):
        groups[n].append(k)
    out = []
    for k, (i, _) in enumerate(rows):
        g = groups[norm[k]]
        best = min(g, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((i, rows[best][0], len(g), sha(norm[k])))
    return out


def test_exact(spark, awkward, empty, prose):
    rows = [(i, t) for i, t, *_ in AWKWARD] + [(100 + i, t.replace(" ", "  ") if i % 3 else t) for i, t in enumerate([*prose, *prose[:30]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(brute_exact(rows))
    assert sum(r.kept for r in got) == len({x[3] for x in brute_exact(rows)}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert len(exact_dedup.exact_groups(awkward).collect()) == len(AWKWARD)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({SPACES.sub("", t or "") for _, t, *_ in AWKWARD})


def test_exact_ambiguous_identifiers(spark, prose):
    """Were two contents to share an identifier, whole texts decide."""
    bad = exact_dedup.ambiguous_chunks(texts_df(spark, prose))
    assert bad.isEmpty()
    rows = texts_df(spark, ["a", "b", "a"]).select(F.col("doc_id").alias("row"), F.array(F.unhex(F.lit("00"))).alias("recipe"), F.col("text").alias("norm"))
    marked = exact_dedup.with_own_text(rows, spark.sql("select unhex('00') as id"))
    assert sorted((r.row, r.norm) for r in marked.collect()) == [(0, "a"), (1, "b"), (2, "a")]
    unmarked = exact_dedup.with_own_text(rows, spark.sql("select unhex('01') as id"))
    assert {r.norm for r in unmarked.collect()} == {None}


def test_chunks_tile_texts():
    pattern = re.compile(exact_dedup.chunk_pattern(16, 64).replace(r"\z", r"\Z"))
    for text in ("", "x", "x" * 1000, "then en er es on " * 50, "日本語" * 100):
        assert "".join(m[0] for m in pattern.finditer(text)) == text
    long = "then the rest of it stands on firm ground " * 60
    a, b = ({m[0] for m in pattern.finditer(t)} for t in (long, "inserted " + long))
    assert len(a & b) > 0.8 * len(a)


@pytest.mark.parametrize("first,last", [(0x4E00, 0x9FA5), (0x3041, 0x3096), (0x5D0, 0x5EA), (0x430, 0x44F), (0x30, 0x39), (0x41, 0x5A), (0x1F600, 0x1F63F)])
def test_chunks_meet_again_in_every_script(first, last):
    """One inserted character changes few chunks, whether of Chinese, kana, Hebrew, Cyrillic, digits, capitals or emoji."""
    import random

    rng = random.Random(first)
    text = "".join(chr(rng.randint(first, last)) for _ in range(100_000))
    pattern = re.compile(exact_dedup.chunk_pattern().replace(r"\z", r"\Z"))
    a, b = ([m[0] for m in pattern.finditer(t.encode().decode("latin-1"))] for t in (text, text[:5000] + chr(first) + text[5000:]))
    assert "".join(a).encode("latin-1").decode() == text
    assert len(a) > 20 and len(set(a) & set(b)) > 0.8 * len(set(a))


def test_exact_chunks_as_in_the_engine(spark):
    """Spark's cuts are those of the pattern on bytes, for every script."""
    texts = ["日本語のテキスト" * 700, "x" * 9000, "Ünïcödé and plain " * 300, "\x80\xff😀" * 900, ""]
    norm = [SPACES.sub("", t) for t in texts]
    pattern = re.compile(exact_dedup.chunk_pattern().replace(r"\z", r"\Z"))
    rows = exact_dedup.recipes(texts_df(spark, texts), "doc_id", "text", 1024, 4096).collect()
    for r in rows:
        chunks = [m[0] for m in pattern.finditer(norm[r.doc_id].encode().decode("latin-1"))]
        assert [bytes(x) for x in r.recipe] == [hashlib.sha256(c.encode()).digest() for c in chunks]


@pytest.mark.parametrize("kind,ids", [("long", [-(2**63), 2**63 - 1, None, 0]), ("string", ["b", "a", None, "c"]), ("decimal(20,0)", [5, 4, None, 6])])
def test_exact_ids_of_any_type(spark, kind, ids):
    docs = spark.createDataFrame([("same",)] * 4, "text string").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    names = spark.createDataFrame([(i, str(x) if x is not None else None) for i, x in enumerate(ids)], "n long, x string")
    docs = docs.join(names, "n").select(F.col("x").cast(kind).alias("doc_id"), "text")
    rows = exact_dedup.exact_groups(docs).collect()
    least = min(x for x in ids if x is not None)
    assert {r.keep_id for r in rows} == {least} and [r.doc_id for r in rows if r.kept] == [least]
