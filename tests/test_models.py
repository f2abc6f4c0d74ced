import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import knowledge as K
from quillon.operators import models as R
from quillon.operators import products
from quillon.plans.model import derive

SF = "/root/testdata/sf0.001"


def test_registry(spark):
    r = R.register(R.register(R.empty_registry(spark), {"model_name": "a", "path": "/x"}), {"model_name": "b", "path": "/y", "extract_level": "all"})
    r = R.register(r, {"model_name": "a", "path": "/z"})
    assert {(m.model_name, m.path, m.extract_level) for m in R.models(r).collect()} == {("a", "/z", "browse"), ("b", "/y", "all")}
    assert {m.model_name for m in R.drop(R.drop(r, "b"), "unknown").collect()} == {"a"}
    assert "server_url" not in R.models(r).columns and R.allows("all", "inference") and not R.allows("browse", "inference")
    with pytest.raises(ValueError):
        R.register(r, {"model_name": "c"})


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    k, t = rng.normal(size=(6, 4)), rng.normal(size=(6, 3))
    rows = spark.createDataFrame([("g", a.tolist(), b.tolist()) for a, b in zip(k, t, strict=True)], "key string, k array<double>, t array<double>")
    delta = np.array(R.ridge(rows, 0.5).first().delta)
    assert np.allclose(delta, t.T @ np.linalg.inv(k @ k.T + 0.5 * np.eye(6)) @ k)
    top = R.singular_vectors(rows.select("key", F.col("k").alias("v")), 2).orderBy("i").collect()
    assert np.allclose([x.value for x in top], np.linalg.svd(k)[1][:2])
    facts = spark.createDataFrame([(0, 1, [1.0, 0.0, 0.0]), (0, 2, [1.0, 1.0, 0.0])], "layer int, feature long, gate array<double>")
    decoys = spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "layer int, v array<double>")
    got = {x.feature: (np.round(x.gate, 6).tolist(), round(x.retained, 6)) for x in R.refined_gates(facts, decoys).collect()}
    assert got == {1: ([0.5, -0.5, 0.0], round(0.5**0.5, 6)), 2: ([0.0, 1.0, 0.0], round(0.5**0.5, 6))}


def test_routing(spark):
    router = spark.createDataFrame([(0, 0, [1.0, 0.0], 0.0, 2.0), (0, 1, [0.0, 1.0], 0.0, 1.0), (0, 2, [-1.0, 0.0], 0.0, 1.0)], "layer int, expert int, w array<double>, bias double, scale double")
    q = spark.createDataFrame([("q", [1.0, 0.5])], "id string, x array<double>")
    got = {r.expert: r.probability for r in R.route(q, router, 2).collect()}
    e = np.exp([1.0, 0.5])
    assert [got[0], got[1]] == pytest.approx((e / e.sum()).tolist())
    got = {r.expert: r.probability for r in R.route(q, router, 2, over_all=True).collect()}
    assert [got[0], got[1]] == pytest.approx([2 * e[0] / e.sum(), e[1] / e.sum()])


def test_approximate_search_recall(spark):
    m = derive(spark, SF)
    q = K.embedded(m.tokens.where("token_id % 50 = 3").select(F.col("token_id").alias("id"), F.col("word").alias("text")), m)
    f = m.features.select("layer", "feature", "gate")
    exact = {(r.id, r.layer, r.feature) for r in K.gate_knn(q, f, 10).collect()}
    found = {(r.id, r.layer, r.feature) for r in R.approximate_knn(q, f, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_codes_find_and_vectors_score(spark, monkeypatch):
    """The candidates of the codes, scored exactly, as by a sort of all pairs, in one right part and in several; no candidate meets a vector in a join."""
    from quillon.functions import text as T
    from quillon.operators import products

    rng = np.random.default_rng(5)
    gates = np.round(rng.normal(size=(300, 6)), 1)
    gates[7], gates[8] = 0.0, 0.3  # no range: codes 0
    gates[40:60] = gates[20:40]
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 6)))]
    q = spark.createDataFrame(asked, "id long, q array<double>")
    f = spark.createDataFrame([(i % 3, i, g.tolist()) for i, g in enumerate(gates)], "layer int, feature long, gate array<double>")
    decoded = {r.feature: r.d for r in f.select("feature", T.sq8_decoded(T.sq8("gate")).alias("d")).collect()}
    assert [decoded[i] for i in range(300)] == R.coded(gates).tolist()
    halves = np.array([[0.0, 255.0, 0.5, 1.5, 0.49999999999999994, 254.5]])
    assert R.coded(halves).tolist() == [[0.0, 255.0, 1.0, 2.0, 0.0, 255.0]]
    want = set()
    for i, v in asked:
        for layer in range(3):
            by_code = sorted((-abs(round(float(np.dot(decoded[j], v)), 9)), j) for j in range(layer, 300, 3))[:8]
            best = sorted((-abs(round(float(gates[j] @ v), 9)), j) for _, j in by_code)[:4]
            want |= {(i, layer, j, n + 1, round(float(gates[j] @ v), 6)) for n, (_, j) in enumerate(best)}
    for held in (64, 1):
        monkeypatch.setattr(products, "HELD_BLOCKS", held)
        monkeypatch.setattr(products, "BLOCK_ROWS", 64)
        found = R.approximate_knn(q, f, 4, 2)
        assert {(r.id, r.layer, r.feature, r["rank"], round(r.score, 6)) for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_texts_take_each_token_once(spark):
    """Tokens go to one task each where texts have no more words than there are tokens; the sums are those of numpy."""
    m = derive(spark, SF)
    texts = m.tokens.where("token_id < 40").select(F.col("token_id").alias("id"), F.concat("word", F.lit(" "), "word", F.lit(" "), F.reverse("word")).alias("text"))
    found = K.embedded(texts, m)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    vectors = {r.token_id: np.array(r.embedding) for r in m.tokens.select("token_id", "embedding").collect()}
    want = {}
    for r in K.token_ids(texts, m).collect():
        want[r.id] = want.get(r.id, 0) + vectors[r.token_id] * m.scale / 3
    got = {r.id: r.q for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i].tolist()) for i in got)


def test_blocks_change_nothing(spark, monkeypatch):
    """One row a block or all rows in one: the same best features, as numpy finds them."""
    from quillon.operators import products

    m = derive(spark, SF)
    q = K.embedded(m.tokens.where("token_id < 5").select(F.col("token_id").alias("id"), F.col("word").alias("text")), m)
    f = m.features.select("layer", "feature", "gate")
    one = {tuple(r) for r in K.gate_knn(q, f, 3).select("id", "layer", "feature", "rank", "score").collect()}
    monkeypatch.setattr(products, "BLOCK_ROWS", 7)
    assert one == {tuple(r) for r in K.gate_knn(q, f, 3).select("id", "layer", "feature", "rank", "score").collect()}
    assert K.gate_knn(q.limit(0), f, 3).count() == 0 and K.gate_knn(q, f.limit(0), 3).count() == 0
    rows, queries = f.collect(), {r.id: np.array(r.q) for r in q.collect()}
    want = set()
    for i, v in queries.items():
        for layer in {r.layer for r in rows}:
            of = sorted((-abs(round(float(np.array(r.gate) @ v), 9)), r.feature) for r in rows if r.layer == layer)[:3]
            want |= {(i, layer, x, n + 1) for n, (_, x) in enumerate(of)}
    assert {r[:4] for r in one} == want


def test_totals_and_predictions(spark, monkeypatch):
    from quillon.operators import clustering as C
    from quillon.operators import products

    monkeypatch.setattr(products, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(2)
    e, x = rng.normal(size=(11, 4)), rng.normal(size=(5, 4))
    tokens = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "token_id long, embedding array<double>")
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, residual array<double>")
    logits = x @ e.T
    p = np.exp(np.tanh(logits / 0.5) * 0.5 / 0.7)
    p /= p.sum(1, keepdims=True)
    got = {(r.id, r.rank): (r.token_id, r.probability) for r in C.predictions(nodes, tokens, 2, 0.7, 0.5).collect()}
    for i in range(5):
        for n, t in enumerate(np.argsort(-logits[i])[:2]):
            assert got[i, n + 1] == (t, pytest.approx(p[i, t]))
    flat = spark.createDataFrame([(i, t, float(v)) for i, row in enumerate(logits) for t, v in enumerate(row)], "id long, token_id long, logit double")
    assert {(r.id, r.rank): (r.token_id, pytest.approx(r.probability)) for r in C.softmax_top(flat, 2, 0.7, 0.5).collect()} == got
    traces = nodes.select(F.col("id").alias("trace_id"), F.lit(0).alias("layer"), "residual")
    for r in C.answer_trajectory(traces, tokens, 6).collect():
        own = np.exp(logits[r.trace_id])
        assert r.rank == 1 + int((logits[r.trace_id] > logits[r.trace_id, 6]).sum()) and r.probability == pytest.approx(own[6] / own.sum())
    assert C.answer_trajectory(traces, tokens, 99).count() == 0


def test_kmeans_against_numpy(spark):
    from quillon.operators import clustering as C

    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6)) + np.repeat(rng.normal(size=(4, 6)) * 3, 50, axis=0)
    got, centres = C.kmeans(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), 4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u[[int(np.linalg.norm(v, axis=1).argmax())]]
    while len(c) < 4:
        c = np.vstack([c, u[(u @ c.T).max(1).argmin()]])
    for _ in range(50):
        at = (u @ c.T).argmax(1)
        new = np.array([u[at == k].mean(0) for k in range(4)])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.abs(new - c).max() < 1e-12:
            break
        c = new
    assert {r.id: r.cluster for r in got.collect()} == dict(enumerate(at.tolist()))
    assert np.allclose([r.centre for r in centres.orderBy("cluster").collect()], c)


def test_contract(spark):
    m = derive(spark, SF)
    pairs = spark.createDataFrame([(1, "the of", "and"), (2, "and", "the of"), (3, None, "the"), (4, "the", "the")], "id long, a string, b string")
    got = {r.id: r.similarity for r in K.similarity(pairs, m).collect()}
    assert got[1] == pytest.approx(got[2]) and got[3] is None and got[4] >= got[1]
    ranked = K.ranked(spark.createDataFrame([(1, "the"), (2, None), (3, ""), (4, "and")], "id long, text string"), "the", m).collect()
    assert [r.id for r in ranked][0] == 1 and {r.id for r in ranked} == {1, 4} and ranked[0].distance < ranked[1].distance
    with pytest.raises(ValueError):
        K.nearest_to(pairs, m, 99)


def test_calls_and_templates(spark):
    assert R.op_call('Sure! ```json\n{"op": "add", "args": {"a": 1}}\n```') == {"op": "add", "args": {"a": 1}}
    assert R.op_call('{"x": 1} then ｛"op"： "mul"｝') == {"op": "mul"} and R.op_call("none {here") is None and R.op_call('{"op": "a}b"}') == {"op": "a}b"}
    t = spark.createDataFrame([("long", [1, 2, 3]), ("short", [1, 2]), ("also", [1, 2])], "template string, tokens array<int>")
    p = spark.createDataFrame([("x", [1, 2, 3, 4]), ("y", [1, 2, 9]), ("z", [5])], "id string, tokens array<int>")
    assert {r.id: r.template for r in R.detected_templates(p, t).collect()} == {"x": "long", "y": "also"}


@pytest.mark.parametrize("magnitude", [True, False])
def test_best_over_many_blocks(spark, monkeypatch, magnitude):
    """A task keeps one set of the best rows over its right blocks; ties by rounded scores, as brute force has them."""
    monkeypatch.setattr(products, "BLOCK_ROWS", 16)
    monkeypatch.setattr(products, "SLICE", 7)
    rng = np.random.default_rng(9)
    x, y = rng.integers(-3, 4, (50, 4)).astype(float), rng.integers(-3, 4, (400, 4)).astype(float)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, q array<double>").coalesce(1)
    right = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(y)], "feature long, layer int, gate array<double>").coalesce(1)
    found = products.best(left, right, 5, [F.col("feature")], left_vector="q", right_vector="gate", key=["id"], per="layer", magnitude=magnitude).collect()
    got = {(r["id"], r["layer"], r["rank"]): (r["feature"], r["score"]) for r in found}
    scores = x @ y.T
    want = {}
    for i in range(50):
        for layer in range(3):
            of = [j for j in range(400) if j % 3 == layer]
            of.sort(key=lambda j: (-(abs(scores[i, j]) if magnitude else scores[i, j]), j))
            want |= {(i, layer, r + 1): (j, scores[i, j]) for r, j in enumerate(of[:5])}
    assert got == want


def test_running_candidates():
    """Of 40 blocks one set of the best is held, with the right rows that it names, not one of each block."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8))
    rest = lambda a, n: pa.StructArray.from_arrays([pa.array(range(a, a + n))], ["at"])
    running = products._Running(x, rest(0, 30), 3, True, None, None, None, False)
    y = rng.normal(size=(40 * 64, 8))
    for a in range(0, len(y), 64):
        running.add(y[a : a + 64], rest(a, 64))
    rows = [r for b in running.result() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(rows) == 90 and len(running.right[0]) <= 90
    for i in range(30):
        assert {r[1] for r in rows if r[0] == i} == set(np.argsort(-np.abs(x[i] @ y.T))[:3].tolist())
