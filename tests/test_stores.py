import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sql as named
from quillon.operators import knowledge as K
from quillon.operators import patches as P
from quillon.operators import ranking as H
from quillon.operators import registries as S
from quillon.plans.model import derive
from quillon.sources import store_dir
from quillon.sources.graphs import append_log
from quillon.streaming.events import replay_into

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dtype", ["f32", "f16"])
def test_store_directory(spark, tmp_path, monkeypatch, dtype):
    """Vectors, embeddings and metadata of a store that numpy wrote, by ranges and by layers."""
    monkeypatch.setattr(store_dir, "PART_BYTES", 64)
    rng = np.random.default_rng(4)
    kind, width, sizes, hidden = {"f32": "<f4", "f16": "<f2"}[dtype], {"f32": 4, "f16": 2}[dtype], [3, 0, 5], 4
    gates = [rng.normal(size=(n, hidden)).astype(kind) for n in sizes]
    e = rng.normal(size=(6, hidden)).astype(kind)
    (tmp_path / "gate_vectors.bin").write_bytes(b"".join(g.tobytes() for g in gates))
    (tmp_path / "embeddings.bin").write_bytes(e.tobytes())
    offsets = np.cumsum([0, *sizes[:-1]]) * hidden * width
    layers = [{"layer": i, "num_features": n, "offset": int(o), "length": n * hidden * width} for i, (n, o) in enumerate(zip(sizes, offsets, strict=True))]
    (tmp_path / "index.json").write_text(json.dumps({"num_layers": 3, "hidden_size": hidden, "vocab_size": 6, "dtype": dtype, "layers": layers}))
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {"<s>": 0, "▁quay": 1, "mole": 2}}}))
    meta = {(0, 0): (1, 0.5, [(1, 0.5), (2, 0.25)]), (0, 2): (5, -1.0, [(5, -1.0)]), (2, 4): (2, 2.0, [(2, 2.0), (1, 1.5)])}
    raw = struct.pack("<4I", 0x444D4554, 1, 3, 2)
    for layer, n in enumerate(sizes):
        raw += struct.pack("<I", n)
        for f in range(n):
            token, score, top = meta.get((layer, f), (0, 0.0, []))
            raw += struct.pack("<If", token, score) + b"".join(struct.pack("<If", *t) for t in [*top, (0, 0.0), (0, 0.0)][:2])
    (tmp_path / "down_meta.bin").write_bytes(raw)
    spark.dataSource.register(store_dir.StoreSource)
    read = lambda **o: spark.read.format("model_store").options(path=str(tmp_path), **o).load()
    got = read(table="gates")
    assert {(r.layer, r.feature): tuple(r.gate) for r in got.collect()} == {(i, k): tuple(g[k].astype(float)) for i, g in enumerate(gates) for k in range(len(g))}
    assert read(table="gates", layers="1-2").count() == 5 and read(table="meta", layers="0").count() == 3
    assert {r.token_id: tuple(r.embedding) for r in read(table="embeddings").collect()} == {i: tuple(v.astype(float)) for i, v in enumerate(e)}
    rows = {(r.layer, r.feature): r for r in read(table="meta").collect()}
    assert len(rows) == 8 and rows[0, 1].token is None
    assert (rows[0, 0].token, rows[0, 0].token_id, rows[0, 0].c_score, [(t.token, t.logit) for t in rows[0, 0].top_k]) == ("quay", 1, 0.5, [("quay", 0.5), ("mole", 0.25)])
    assert rows[0, 2].token == "T5" and rows[2, 4].token == "mole"
    (tmp_path / "down_meta.bin").write_bytes(b"\0" * 16)
    with pytest.raises(Exception, match="known version"):
        read(table="meta").count()


def test_named_functions(spark):
    m = derive(spark, SF)
    named.register(spark, m)
    a, b, c = (r.word for r in m.tokens.orderBy("token_id").limit(3).collect())
    text = f"{a} zzyzx {b}"
    want = {tuple(r) for r in K.walk(spark.createDataFrame([(1, text)], "id long, text string"), m).select("layer", "rank", "feature", "activation", "concept").collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM walk(prompt => :t)", {"t": text}).collect()} == want
    assert spark.sql("SELECT * FROM walk(:t, top => 2)", {"t": text}).count() == 2 * m.layers
    pair = spark.createDataFrame([(1, a, f"{b} {c}")], "id long, a string, b string")
    one = spark.sql("SELECT similarity, distance_of(similarity) AS d FROM similar_to(:a, b => :b)", {"a": a, "b": f"{b} {c}"}).first()
    assert one.similarity == pytest.approx(K.similarity(pair, m).first().similarity) and one.d == pytest.approx(K.distances(pair, m).first().distance)
    assert spark.sql("SELECT * FROM walk('123 !!')").count() == 0
    near = K.nearest_to(spark.createDataFrame([(1, text)], "id long, text string"), m, 4, 5)
    assert {r.feature for r in spark.sql("SELECT * FROM nearest(:t, 4, top => 5)", {"t": text}).collect()} == {r.feature for r in near.collect()}


def test_similar_to_many(spark):
    m = derive(spark, SF)
    a, b = (r.word for r in m.tokens.orderBy("token_id").limit(2).collect())
    rows = spark.createDataFrame([(1, a, [b, None, "", a]), (2, a, []), (3, None, [b]), (4, a, None)], "id long, a string, texts array<string>")
    got = {r.id: r.similarities for r in K.similar_to_many(rows, m).collect()}
    alone = {r.id: r.similarity for r in K.similarity(spark.createDataFrame([(1, a, b), (2, a, a)], "id long, a string, b string"), m).collect()}
    assert got == {1: [pytest.approx(alone[1]), None, None, pytest.approx(alone[2])], 2: [], 3: [None], 4: None}


def test_signals(spark):
    def grams(t):
        import re

        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for i in range(len(w) + 1)}

    texts = [("Grey Quay", "grey quays"), ("x", "y"), ("", ""), ("Äther 9", "äther"), ("one two", "two")]
    df = spark.createDataFrame(texts, "a string, b string")
    for r in df.select("a", "b", H.trigram_similarity("a", "b").alias("t"), H.word_share("a", "b").alias("w")).collect():
        x, y = grams(r.a), grams(r.b)
        assert r.t == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)
        asked, has = set(r.b.lower().split()), set(r.a.lower().split())
        assert r.w == pytest.approx(len(asked & has) / len(asked) if asked else 0.0)
    m = derive(spark, SF)
    word = m.tokens.where("token_id = 3").first().word
    rows = spark.createDataFrame([(1, word), (2, None), (3, "zzyzx"), (4, word + "s")], "id long, text string")
    got = H.hybrid_rank(rows, word, m).collect()
    assert [r.id for r in got][0] == 1 and {r.id for r in got} == {1, 2, 3, 4} and next(r.score for r in got if r.id == 2) == 0


def test_facts(spark):
    rng = np.random.default_rng(3)
    k, t = rng.normal(size=(4, 5)), rng.normal(size=(4, 3))
    facts = spark.createDataFrame([("g", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(k, t, strict=True))], "key string, fact int, k array<double>, t array<double>")
    delta = t.T @ np.linalg.inv(k @ k.T + 0.1 * np.eye(4)) @ k
    for r in P.solved_facts(facts, 0.1).collect():
        made = delta @ k[r.fact]
        assert np.allclose(r.decomposed, made) and r.cosine == pytest.approx(made @ t[r.fact] / np.linalg.norm(made) / np.linalg.norm(t[r.fact]))
    cycles = spark.createDataFrame([(0, 0, "Alma", "Calls"), (1, 0, "ALMA", "lies"), (1, 1, "Bryn", "calls")], "cycle int, pos int, entity string, relation string")
    asked = spark.createDataFrame([(1, "alma", None), (2, "alma", "CALLS"), (3, "none", None)], "id int, entity string, relation string")
    assert {(r.id, r.cycle, r.pos) for r in P.facts_of(cycles, asked).collect()} == {(1, 0, 0), (1, 1, 0), (2, 0, 0)}


def test_entries_and_keys(spark):
    ops = spark.createDataFrame([(0, 0, "insert_knn", 2, 1, "T", None, 0.9, [1.0, 0.0], "Alma", "is"), (0, 1, "insert_knn", 1, 2, "U", None, 0.9, [0.0, 2.0], "alma", "is"), (0, 2, "update", 1, 2, "V", None, None, None, None, None)], P.PATCH_SCHEMA)
    entries = P.knn_entries(ops)
    assert [(r.layer, r.target) for r in P.entries_of(entries, "ALMA").collect()] == [(1, "U"), (2, "T")]
    assert {(r.layer, r.entries) for r in P.entry_counts(entries).collect()} == {(1, 1), (2, 1)}
    assert {(r.op_no, None if r.key is None else tuple(r.key)) for r in P.op_key(ops).collect()} == {(0, None), (1, None), (2, (1, 2))}


def test_registries(spark, tmp_path):
    t = tmp_path / "t.json"
    t.write_text(json.dumps([{"relation": "calls", "template": "old {subject}"}, {"relation": "calls", "template": "{subject} calls at", "multi_token": True}, {"template": "no relation"}, {"relation": "lies", "template": "{subject} lies", "stop_tokens": ["."]}]))
    templates = S.templates_of_json(spark, str(t))
    assert {(r.relation, r.template) for r in templates.collect()} == {("calls", "{subject} calls at"), ("lies", "{subject} lies")}
    more = S.register_template(templates, spark.createDataFrame([("lies", "new")], "relation string, template string"))
    assert {(r.relation, r.template) for r in more.collect()} == {("calls", "{subject} calls at"), ("lies", "new")}
    S.to_json(templates, str(tmp_path / "back"))
    assert {r.relation for r in spark.read.json(str(tmp_path / "back")).collect()} == {"calls", "lies"}
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"relations": [{"name": "calls"}, {"reversible": True}, {"name": "calls", "reversible": True}], "type_rules": [{"node_type": "ship", "outgoing": ["calls"]}, {"outgoing": ["x"]}]}))
    relations, rules = S.schema_of_json(spark, str(s))
    assert [(r.name, r.reversible) for r in relations.collect()] == [("calls", True)]
    assert [(r.rule_no, r.node_type, r.outgoing, r.incoming) for r in rules.collect()] == [(0, "ship", ["calls"], [])]
    known = spark.createDataFrame([("at", "Mole pier", 0.5), ("calls at ", "Skerry", 0.25)], "suffix string, answer string, probability double")
    asked = spark.createDataFrame([(1, "Alma calls at"), (2, "look at "), (3, "nothing")], "id int, prompt string")
    got = {r.id: (r.t, r.p) for r in S.mock_answers(asked, known).select("id", S.top_token("predictions").alias("t"), S.top_probability("predictions").alias("p")).collect()}
    assert got == {1: (" Skerry", 0.25), 2: (" Mole", 0.5), 3: (None, 0.0)}


def test_replay(spark, tmp_path):
    """A log is taken over once however often it repeats itself; a second call reads only what is new."""
    log, table, marks = (str(tmp_path / n) for n in ("log", "edges", "marks"))
    e = spark.createDataFrame([(f"s{i % 6}", "r", f"o{i % 3}", 0.5, "manual") for i in range(20)], "subject string, relation string, object string, confidence double, source string")
    append_log(e, log)
    replay_into(spark, log, table, marks)
    append_log(e.withColumn("subject", F.concat("subject", F.when(F.col("object") == "o1", "x").otherwise(""))), log)
    replay_into(spark, log, table, marks)
    got = spark.read.parquet(table)
    assert got.count() == got.select("subject", "object").distinct().count() == 8
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1}


def test_staged_tables_are_cleared(tmp_path):
    """In a session of its own: what was staged goes, models are derived anew, and a cluster without a shared folder is an error."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from pathlib import Path
from quillon import staging
df = staging.staged(spark.range(5).toDF("x"), "t", codec="zstd")
assert df.count() == 5 and len(list(Path("{tmp_path}").glob("t-*"))) == 1
assert staging.clear(spark) == 1 and not list(Path("{tmp_path}").glob("t-*")) and staging.age(spark) == 1
assert staging.staged(spark.range(3).toDF("x")).count() == 3
class Cluster:
    master, applicationId = "spark://x", "a"
class Session:
    sparkContext = Cluster
    class conf:
        get = staticmethod(lambda *a: "")
try:
    staging.shared_dir(Session)
except RuntimeError:
    print("fine")
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_messages(spark, tmp_path):
    """MessagePack of every kind of value, and graphs in it; packed graphs are told by their first bytes."""
    from quillon.sources import graphs

    value = {"a": [None, True, False, 0, -1, 127, 128, -33, 2**40, -(2**40), 1.5, "", "grüß" * 20], "b": {str(i): i for i in range(40)}, "c": list(range(30)), "d": {}}
    assert graphs._parsed(graphs._message(value)) == (value, len(graphs._message(value)))
    assert graphs._parsed(b"\xcc\xff")[0] == 255 and graphs._parsed(b"\xcd\x01\x00")[0] == 256 and graphs._parsed(b"\xca\x3f\xc0\x00\x00")[0] == 1.5 and graphs._parsed(b"\xd9\x02ab")[0] == "ab"
    for broken in (b"", b"\xa5ab", b"\xc1", b"\x92\x01"):
        with pytest.raises(ValueError):
            graphs._parsed(broken)
    edges = [{"s": "Alma", "r": "calls", "o": "Mole", "c": 1.75, "src": "manual", "meta": {"layer": 3, "note": "x"}, "inj": [2, 0.5]}, {"s": "Bryn", "r": "calls", "o": "Quay"}, {"s": "x"}]
    (tmp_path / "g.msgpack").write_bytes(graphs.messaged(edges))
    got = {r.subject: r for r in graphs.load(spark, str(tmp_path / "g.msgpack")).collect()}
    assert set(got) == {"Alma", "Bryn"} and (got["Alma"].confidence, got["Alma"].metadata, got["Alma"].injection.layer) == (1.0, {"layer": "3", "note": "x"}, 2) and got["Bryn"].source == "unknown"
    (tmp_path / "h.pak").write_bytes(graphs.packed([("a", "r", "b", 0.5, "manual")]))
    assert [(r.subject, r.confidence, r.source) for r in graphs.load(spark, str(tmp_path / "h.pak")).collect()] == [("a", 0.5, "manual")]


def test_build(spark, tmp_path):
    from quillon.sources import stores

    rows = [(x, f, [1.0, float(f)], f, f"word{f}" if f != 2 else None, 0.5, [("quay" if f == 0 else "other", 1, 0.3)]) for x in range(4) for f in range(4)]
    spark.createDataFrame(rows, "layer int, feature long, gate array<double>, token_id long, token string, c_score double, top_k array<struct<token:string,token_id:bigint,logit:double>>").write.parquet(str(tmp_path / "base"))
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "operations": [{"op": "update", "layer": 3, "feature": 3, "target": "Patched", "down_meta": {"top_token": "Patched", "top_token_id": 9, "c_score": 0.7}}]}))
    text = 'FROM base\nPATCH p.json # a comment\nINSERT ("a", "b", "Lantern")\nSTAGE dev\nINSERT ("a", "b", "Second")\nSTAGE other\nDELETE "" "" "quay"\n'
    label = lambda df: {(r.layer, r.feature): r.token for r in df.collect()}
    plain, history = stores.build(spark, text, folder=str(tmp_path))
    assert label(plain) == {(x, f): "Patched" if (x, f) == (3, 3) else "Lantern" if (x, f) == (2, 2) else None if f == 2 else f"word{f}" for x in range(4) for f in range(4)}
    assert [(r.position, r.changed) for r in history.orderBy("position").collect()] == [(0, 0), (1, 1), (2, 1)]
    dev = label(stores.build(spark, text, "dev", str(tmp_path))[0])
    assert dev[2, 2] == "Lantern" and list(dev.values()).count("Second") == 1
    other, history = stores.build(spark, text, "other", str(tmp_path))
    assert all(label(other)[x, 0] is None for x in range(4)) and history.orderBy("position").collect()[-1].changed == 4
    with pytest.raises(ValueError):
        stores.build(spark, text, "none", str(tmp_path))


def test_classify_and_chat_forms(spark):
    from quillon.functions import text as T
    from quillon.operators import models as R

    rng = np.random.default_rng(7)
    mean, axes, turns, b = rng.normal(size=5), rng.normal(size=(3, 5)), rng.normal(size=(4, 3)), rng.normal(size=4)
    v = rng.normal(size=(40, 5))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(40, [1.0]), (41, None)]
    got = {r.id: r.route for r in R.classify(spark.createDataFrame(rows, "id int, v array<double>"), mean, axes, turns, b, list("abcd")).collect()}
    assert got == {**{i: "abcd"[int((turns @ (axes @ (x - mean)) + b).argmax())] for i, x in enumerate(v)}, 40: "unknown", 41: "unknown"}
    forms = spark.createDataFrame([("Org/Mixtral-8", "gemma4"), ("deepseek-coder", "gpt_oss"), ("my-model", "other"), (None, None)], "m string, f string")
    assert [tuple(r) for r in forms.select(T.chat_form("m"), T.family_form("f")).collect()] == [("mistral", "gemma"), ("chatml", "chatml"), ("plain", "plain"), ("plain", "plain")]
    ask = spark.createDataFrame([("hi",)], "p string")
    assert ask.select(T.wrapped("p", F.lit("chatml")), T.wrapped("p", F.lit("plain"))).first()[:] == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n", "hi")


def test_attention_walk(spark):
    from quillon.operators import clustering as C

    rng = np.random.default_rng(12)
    e, ov = rng.normal(size=(30, 4)), rng.normal(size=(2, 2, 4, 4))
    tokens = spark.createDataFrame([(i, f"t{i}", x.tolist()) for i, x in enumerate(e)], "token_id long, token string, embedding array<double>")
    heads = spark.createDataFrame([(x, h, ov[x, h].tolist()) for x in range(2) for h in range(2)], "layer int, head int, ov array<array<double>>")
    want = {}
    for x in range(2):
        raw = []
        for h in range(2):
            made = e @ ov[x, h].T
            size = np.linalg.norm(made, axis=1)
            for i in np.argsort(-size)[:6]:
                out = made[i] @ e.T
                raw += [(h, i, j, size[i], out[j]) for j in np.argsort(-out)[:3] if out[j] >= 0.02]
        most, most_in = max(r[3] * r[4] for r in raw), max(r[3] for r in raw)
        want |= {(f"L{x}-H{h}", f"t{i}", f"t{j}"): (a * b / most, a / most_in) for h, i, j, a, b in raw}
    got = {(r.relation, r.subject, r.object): (r.confidence, r.selectivity) for r in C.attention_walk(heads, tokens, 3, wide=2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
