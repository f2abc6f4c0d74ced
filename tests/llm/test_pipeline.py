import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.common import remainder
from quillon.llm.exact_dedup import exact_groups
from quillon.llm.mixing import mixed
from quillon.llm.quality import scored
from quillon.llm.simhash import near_duplicates
from tests.llm.conftest import AWKWARD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        made = f(spark, docs, SF).persist()
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_decide(spark, stages):
    for docs, made in stages[:-1]:
        assert made.columns == docs.columns
    (d0, s0), (d1, s1), (d2, s2), (d3, s3), (d4, s4) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(s0) == ids(scored(d0, labels, remainder("doc_id", 5) == 0).where("predicted = 1"))
    assert 0.6 * d0.count() < s0.count() < d0.count()
    assert ids(s1) == ids(exact_groups(d1).where("kept")) and s1.count() < d1.count()
    assert s1.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count() == s1.count()
    assert ids(s2) == ids(near_duplicates(d2).where("doc_id = component_id"))
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixed(d3).collect() if r.taken}
    assert ids(s3) == Counter(taken)
    assert ids(s4) == ids(d4)


def test_awkward_rows(spark, awkward, empty):
    for name, f in corpus_pipeline.STAGES:
        for df in (awkward, empty):
            made = f(spark, df, SF)
            n = made.count()
            assert n <= 3 * df.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == df.columns


def test_run(spark):
    made = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(made.columns) and made.count() > 100
    assert len(AWKWARD) and re.match("quality", corpus_pipeline.STAGES[0][0])


def test_near_removes_rows_not_ids(spark):
    """Clean rows stay beside a removed one of their id or of null id."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    a, b, c, d, e = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(5))
    rows = [(1, a), (None, a.upper()), (None, b), (None, c), (7, a.title()), (7, d), (8, e)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, SF).collect())
    assert kept == Counter([(1, a), (None, b), (None, c), (7, d), (8, e)])


def test_mixing_takes_rows_not_ids(spark):
    """Rows of one id or of null id come back as often as the mix takes each, with their own texts."""
    rows = [(i % 3 or None, " ".join(f"w{i}" for _ in range(i + 3)), "en", "ab"[i % 2]) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    numbered = docs.withColumn("n", F.monotonically_increasing_id())
    want = Counter()
    for r in mixed(numbered, row_col="n").collect():
        if r.taken:
            want[rows[r.row][1]] += -(-r.taken // r.size)
    assert Counter(r.text for r in corpus_pipeline.mixing(spark, docs, SF).collect()) == want
    assert max(want.values()) <= 3
