import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import clustering as C
from quillon.operators import labelling as L
from quillon.operators import models as R


def test_tfidf_leaves_out_stop_words(spark):
    rows = spark.createDataFrame([(0, 1, "the|harbour"), (0, 2, "and|harbour"), (1, 3, "for"), (1, 4, "a|\u2014\u2014\u2014"), (2, 5, "quay|mole")], "cluster int, feature long, text string")
    got = {r.cluster: (r.label, r.tokens) for r in C.tfidf_labels(rows).collect()}
    assert got == {0: ("harbour", ["harbour"]), 1: ("cluster-1", []), 2: ("mole/quay", ["mole", "quay"])}


@pytest.mark.parametrize("members,want", [
    (["danish", "finnish", "czech", "harbour"], "language"), (["Egypt", "Norway", "Peru"], "country"), (["may", "june", "quay", "mole"], "month"),
    (["two", "nine", "sixth", "harbour"], "number"), (["er", "ly", "harbour"], "morphological"), (["harbour", "lantern", "mole"], None), ([], None)])
def test_entity_pattern(spark, members, want):
    df = spark.createDataFrame([(members,)], "m array<string>")
    assert df.select(L.entity_pattern("m").alias("p")).first().p == want


def test_relations_of_files(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"port of": {"pairs": [["Bergen", "Norway"], ["Genoa", "Italy"], ["", "x"], ["alone"]]}, "in": {"pairs": [["Genoa", "Italy"], ["http://x", "y (z)"]]}}))
    db = L.relation_database(spark, str(path))
    assert db.count() == 4
    asked = spark.createDataFrame([(1, "GENOA", "italy"), (2, "Bergen", "Italy")], "id int, subject string, object string")
    assert {(r.id, r.relation) for r in L.known_relations(db, asked).collect()} == {(1, "port of"), (1, "in")}
    assert {r.entity for r in L.probe_entities(spark, str(path)).collect()} == {"Bergen", "Norway", "Genoa", "Italy", "alone"}
    words = tmp_path / "w.json"
    words.write_text('["harbour", "quay"]')
    assert [r.word for r in L.category_words(spark, str(tmp_path / "none.json"), str(words)).orderBy("position").collect()] == ["harbour", "quay"]
    assert L.category_words(spark, str(tmp_path / "none.json")).count() == 140


def test_category_labels(spark):
    e = np.eye(6).tolist()
    tokens = spark.createDataFrame([(i + 3, w, e[i]) for i, w in enumerate(["harbour", "quay", "lantern", "may", "june", "zzzzz"])] + [(9, "port", [0.6, 0.6, 0.0, 0.0, 0.0, 0.1])], "token_id long, word string, embedding array<double>")
    members = spark.createDataFrame([(0, 1, "Harbour|Quay"), (1, 2, "May|June"), (2, 3, "the"), (3, 4, "unknown")], "cluster int, feature long, text string")
    categories = spark.createDataFrame([(0, "lantern"), (1, "Port")], "position int, word string")
    got = {r.cluster: r.label for r in L.category_labels(members, tokens, categories).collect()}
    assert got == {0: "port", 1: "month", 2: "cluster-2", 3: "unknown"}


def test_labels_by_pairs_and_outputs(spark):
    db = spark.createDataFrame([("port of", "bergen", "norway"), ("port of", "genoa", "italy"), ("in", "genoa", "italy"), ("in", "oslo", "norway")], "relation string, subject_lc string, object_lc string")
    pairs = spark.createDataFrame([(0, "Bergen", "Norway"), (0, "Genoa", "Italy"), (0, "x", "y"), (1, "Genoa", "Italy"), (1, "x", "y")], "cluster int, in_token string, out_token string")
    assert [(r.cluster, r.relation, r.hits) for r in C.pair_labels(pairs, db).collect()] == [(0, "port of", 2)]
    only = db.where("relation = 'port of' or subject_lc = 'oslo'")
    outs = spark.createDataFrame([(0, "Italy"), (0, "Italy"), (0, "Norway"), (1, "Norway"), (1, "Norway"), (2, "Italy")], "cluster int, out_token string")
    assert [(r.cluster, r.relation, r.hits) for r in C.output_labels(outs, only).collect()] == [(0, "port of", 3)]


def test_confirmed_pairs_directions_and_templates(spark):
    probed = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, [str(i) for i in range(21)]), (0, 3, ["c"])], "layer int, feature long, entities array<string>")
    features = spark.createDataFrame([(0, 1, "Quay", 5), (0, 2, "Mole", 6), (0, 3, "x", 7)], "layer int, feature long, token string, token_id long")
    assert {(r.feature, r.entity, r.token) for r in C.confirmed_pairs(probed, features).collect()} == {(1, "a", "Quay"), (1, "b", "Quay")}
    tokens = spark.createDataFrame([(1, [1.0, 0.0]), (5, [3.0, 4.0]), (6, [0.0, 0.0]), (8, [0.0, 0.0])], "token_id long, embedding array<double>")
    ins = spark.createDataFrame([(0, 1, 8), (0, 2, 8), (0, 4, 8)], "layer int, feature long, token_id long")
    outs = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 4, 1)], "layer int, feature long, token_id long")
    got = {r.feature: r.direction for r in R.offset_directions(outs, ins, tokens).collect()}
    assert got == {1: [0.6, 0.8], 2: None, 4: None}
    hits = spark.createDataFrame([("t", 0, 1, 0.9), ("t", 0, 2, -0.8), ("t", 0, 3, 0.1), ("t", 1, 1, 0.7)], "template string, layer int, feature long, score double")
    assert {(r.template, r.layer): r.features for r in R.template_universe(hits, 0.5).collect()} == {("t", 0): [1, 2], ("t", 1): [1]}
    index = spark.createDataFrame([(5, 0, 1, 0.5), (5, 0, 2, -0.9), (6, 0, 1, -0.7)], "token_id long, layer int, feature long, act double")
    wanted = spark.createDataFrame([("q", 5), ("q", 6)], "id string, token_id long")
    assert [(r.feature, r.act) for r in R.looked_up(index, wanted, 2).orderBy("rank").collect()] == [(2, -0.9), (1, -0.7)]


def test_labelled_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, i, (np.eye(4)[i % 2] + rng.normal(size=4) * 0.01).tolist(), ["Norway", "Italy"][i % 2], ["quay|mole", "lantern"][i % 2]) for i in range(20)]
    rows.append((0, 99, None, "Norway", "none"))
    features = spark.createDataFrame(rows, "layer int, feature long, direction array<double>, out_token string, text string")
    tokens = spark.createDataFrame([(5, "quay", [1.0, 0.0])], "token_id long, word string, embedding array<double>")
    relations = spark.createDataFrame([("port of", "bergen", "norway")], "relation string, subject_lc string, object_lc string")
    placed, clusters = L.labelled_clusters(features, tokens, spark.createDataFrame([(0, "none")], "position int, word string"), relations, k=2)
    assert placed.count() == 20 and {(r.label, r["count"]) for r in clusters.collect()} == {("port of", 10), ("lantern", 10)}
    named = L.relation_labels(placed, clusters)
    assert named.count() == 20 and named.where(F.col("relation") == "port of").select(F.pmod("feature", F.lit(2)).alias("m")).distinct().count() == 1
