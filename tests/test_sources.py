import base64
import json
import struct
import sys

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import clustering as C
from quillon.operators import patches as P
from quillon.sources import graphs, stores
from quillon.streaming.events import edge_stream, event_windows, last_positions

ROWS = [("France", "capital-of", "Paris", 0.5, "manual"), ("Zürich", "in", "Schweiz", 1.0, "unknown")]


def rows(df):
    return sorted((r.subject, r.relation, r.object, r.confidence, r.source) for r in df.collect())


def test_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("subject,relation,object,confidence,source\na,r,b,0.5,manual\nc,r,d,bad\nshort,line\ne,r,f\ng,r,h,0.25,document,more\n")
    assert rows(graphs.load(spark, str(tmp_path / "g.csv"))) == [("a", "r", "b", 0.5, "manual"), ("c", "r", "d", 1.0, "unknown"), ("e", "r", "f", 1.0, "unknown"), ("g", "r", "h", 0.25, "document,more")]
    graphs.write_csv(spark.createDataFrame(ROWS, graphs.EDGE), str(tmp_path / "out.csv"))
    assert rows(graphs.load(spark, str(tmp_path / "out.csv"))) == sorted(ROWS)


def test_json_and_log(spark, tmp_path):
    edges = [{"s": "a", "r": "r", "o": "b", "c": 1.5, "src": "manual", "meta": {"layer": "3"}, "inj": [3, 0.5]}, {"s": "c", "r": "r", "o": "d"}]
    (tmp_path / "g.json").write_text(json.dumps({"edges": edges}, indent=1))
    got = {r.subject: r for r in graphs.load(spark, str(tmp_path / "g.json")).collect()}
    assert (got["a"].confidence, got["a"].metadata, got["a"].injection.layer, got["c"].source, got["c"].confidence) == (1.0, {"layer": "3"}, 3, "unknown", 1.0)
    log = tmp_path / "log.ndjson"
    log.mkdir()
    (log / "1.json").write_text('{"s":"a","r":"r","o":"b"}\nno edge\n{"s":"a","r":"r","o":"b"}\n')
    assert graphs.load(spark, str(log)).count() == 2
    graphs.append_log(spark.createDataFrame(ROWS, graphs.EDGE), str(log))
    assert graphs.load(spark, str(log)).count() == 4
    q = edge_stream(spark, str(log)).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("replayed").count() == 3  # each triple once
    with pytest.raises(ValueError):
        graphs.load(spark, "graph.xyz")


def test_packed(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(graphs.packed(ROWS))
    assert rows(graphs.load(spark, str(tmp_path / "g.bin"))) == sorted(ROWS)
    assert graphs.unpacked(graphs.packed([])) == []
    with pytest.raises(ValueError):
        graphs.unpacked(b"XXXX" + graphs.packed(ROWS)[4:])


def test_vectors_labels_patches(spark, tmp_path):
    (tmp_path / "v.ndjson").write_text('{"_header": true, "dimension": 2}\n{"id": "L0_F1", "layer": 0, "feature": 1, "vector": [0.5, 1.0], "top_token": "Paris", "top_token_id": 7, "c_score": 0.9, "top_k": [{"token": "Paris", "token_id": 7, "logit": 0.9}]}\n')
    row = stores.read_vectors(spark, str(tmp_path / "v.ndjson")).first()
    assert (row.layer, row.feature, row.gate, row.token, row.top_k[0].logit) == (0, 1, [0.5, 1.0], "Paris", 0.9)
    (tmp_path / "l.ndjson").write_text('{"_header": true}\n{"l": 1, "f": 2, "t": "capital"}\n{"layer": 3, "feature": 4, "label": "river"}\n')
    assert {tuple(r) for r in stores.read_labels(spark, str(tmp_path / "l.ndjson")).collect()} == {(1, 2, "capital"), (3, 4, "river")}
    b64 = base64.b64encode(struct.pack("<3f", 1.5, -0.25, 0.0)).decode()
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "operations": [{"op": "insert", "layer": 0, "feature": 1, "target": "Lyon", "confidence": 0.4, "gate_vector_b64": b64}, {"op": "delete", "layer": 0, "feature": 2}]}))
    ops = stores.read_patches(spark, str(tmp_path / "p.json"))
    assert ops.where("op_no = 0").first().gate == [1.5, -0.25, 0.0]
    base = spark.createDataFrame([(0, 1, [1.0], 5, "Paris", 0.9, []), (0, 2, [2.0], 6, "Rome", 0.8, [])], "layer int, feature long, gate array<double>, token_id long, token string, c_score double, top_k array<struct<token:string,token_id:long,logit:double>>")
    view = {r.feature: r for r in P.overlay(base, ops).collect()}
    assert (view[1].token, view[1].c_score, view[2].token, view[2].gate) == ("Lyon", 0.4, None, None)
    assert {r.file for r in stores.checksums(spark, str(tmp_path / "p.json")).collect()} == {"p.json"}
    stores.bake(P.overlay(base, ops.limit(0)), str(tmp_path / "baked"))
    assert spark.read.parquet(str(tmp_path / "baked")).count() == 2


def test_build_file():
    assert stores.build_plan('FROM base # the model\nINSERT ("a", "b", "c")\nEXPOSE x y\n') == [("FROM", ["base"]), ("INSERT", ["a", "b", "c"]), ("EXPOSE", ["x", "y"])]
    for bad in ("PATCH p", "FROM x\nJUMP"):
        with pytest.raises(ValueError):
            stores.build_plan(bad)


def test_override(spark):
    raw = spark.createDataFrame([("q", 1, "a", 0.6), ("q", 2, "b", 0.3), ("p", 1, "c", 0.9)], "id string, rank int, token string, probability double")
    hits = spark.createDataFrame([("q", 3, 1, 0.8, "late"), ("q", 1, 1, 0.76, "early"), ("p", 0, 1, 0.75, "weak")], "id string, layer int, rank int, cosine double, target string")
    got = {(r.id, r.rank): (r.token, r.probability) for r in P.knn_override(raw, hits, 2).collect()}
    assert got == {("q", 1): ("early", 1.0), ("q", 2): ("a", 0.6), ("p", 1): ("c", 0.9)}


RELATIONS = [
    (0, 30, "test", 10, [], "related_to"), (5, 30, "Paris", 50, ["city"], "related_to"), (25, 30, "dog", 10, [], "similar_to"), (29, 30, "Paris", 50, ["city"], "similar_to"), (15, 30, "Europe", 35, ["continent"], "part_of"),
    (15, 30, "Paris", 10, ["city", "capital"], "located_in"), (15, 30, "Einstein", 10, ["physicist"], "instance_of"), (15, 30, "tall", 25, ["height"], "has_property"), (15, 30, "warm", 5, [], "related_to"), (3, 0, "Paris", 50, ["city"], "related_to"),
]


def test_relations(spark):
    df = spark.createDataFrame([(a, b, c, float(d), e, f) for a, b, c, d, e, f in RELATIONS], "layer int, layers int, target string, score double, sec array<string>, want string")
    got = df.select("want", T.classify_relation(F.col("layer"), F.col("layers"), F.col("target"), F.col("score"), F.col("sec")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_tokens(spark):
    cases = [("Paris", True, True), ("the", True, False), ("camelCase", True, False), ("ab", True, False), ("", False, False), ("日本語日本語", False, False), ("x" * 31, False, False), ("x" * 26, True, False), ("a1b2", True, True), ("12345", True, False), (" Paris ", True, True)]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", T.is_readable("t").alias("r"), T.is_content("t").alias("c")).collect()
    assert [(r.t, r.r, r.c) for r in got] == cases
    row = spark.range(1).select(T.score_to_distance(F.lit(0.0)).alias("z"), T.score_to_distance(F.lit(3.0)).alias("d"), T.url_encoded(F.lit("a b~*é")).alias("u")).first()
    assert (row.z, row.d, row.u) == (sys.float_info.max, 0.25, "a%20b~%2A%C3%A9")


def test_vectors(spark):
    v = F.array(*map(F.lit, [0.0, 0.5, 1.0, -1.0, 0.25, 0.75]))
    row = spark.range(1).select(T.sq8(v).alias("q"), T.sq8_distance(v, T.sq8(v)).alias("d"), T.cosine(v, F.transform(v, lambda x: x * 0)).alias("z"), F.round(T.norm(T.l2_normalize(v)), 9).alias("n")).first()
    assert (row.q.lo, row.q.hi, row.q.codes[3], row.q.codes[2], row.z, row.n) == (-1.0, 1.0, 0, 255, 0.0, 1.0) and row.d < 0.02


def test_kmeans(spark):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(5)], "id int, v array<double>")
    got, centres = C.kmeans(df, 2)
    by = {r.id: r.cluster for r in got.collect()}
    assert len({by[i] for i in range(5)}) == len({by[10 + i] for i in range(5)}) == 1 and by[0] != by[10] and centres.count() == 2
    assert C.kmeans(df.limit(0), 2)[0].count() == 0


def test_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()
    tokens = spark.createDataFrame([("a", i) for i in range(10)], "id string, pos int")
    assert sorted(r.pos for r in last_positions(tokens, 3).collect()) == [7, 8, 9]
