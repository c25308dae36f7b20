"""Candidates by runs of characters, the index of vectors, and searches over both."""

import random

import numpy as np
import pytest
from nodeloom.operators import search as se
from nodeloom.operators import vectors as vx


def test_containing_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    names = [(i, text(rng.randrange(0, 14))) for i in range(300)] + [(900, "ab"), (901, "a"), (902, ""), (903, "naïve 世界ab")]
    words = ["ab", "abc", "de", "aaa", "zz", "zzz", "a", "", "世界", "bcdeab"] + [text(rng.randrange(2, 5)).replace(" ", "a") for _ in range(40)]
    got = {(r.w, r.id) for r in se.containing(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame(names, "id long, l string")).collect()}
    assert got == {(w, i) for w in words if len(w) >= 2 for i, n in names if w in n}


def test_candidates_of_many_queries(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"Person {i} Smith", ["person"], i % 2 == 0) for i in range(400)], "id string, name string, tags array<string>, entity boolean")
    queries = spark.createDataFrame([(f"person {i}",) for i in range(0, 400, 2)] + [("Smith, Person 7",)], "query string")
    plan = se.candidates(queries, nodes, limit=5)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = se.candidates(queries, nodes, limit=5).collect()
    assert {r.query for r in got} == {r.query for r in queries.collect()}
    assert max(sum(r.query == q for r in got) for q in {r.query for r in got}) <= 10
    exact = se.candidates(spark.createDataFrame([("PERSON 7  Smith",)], "query string"), nodes).filter("how = 'exact'").collect()
    assert [(r.id, r.confidence) for r in exact] == [("n7", 1.0)]
    meant = spark.createDataFrame([("q", "n3", 0.9), ("q", "n4", 0.4)], "query string, id string, similarity double")
    assert [(r.id, r.how, r.confidence) for r in se.candidates(spark.createDataFrame([("q",)], "query string"), nodes, semantic=meant).collect()] == [("n3", "semantic", 0.76)]


def test_least_score():
    assert [se.least_score(x) for x in ("75", "0.5", "1", "0", "100", "1.0", "150", "-3", "1.5", "x", None, "80%")] == [0.75, 0.5, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, None, None, 0.8]


def test_semantic_search(spark):
    nodes = spark.createDataFrame([(1, "Alpha", ["x"]), (2, " - [[alpha", ["x"]), (3, "Alpha", ["y"]), (4, "[[ref]]", ["x"]), (5, " ", ["x"]), (6, "Gone", ["x"]), (7, "Far", ["x"])], "id long, name string, tags array<string>")
    hits = spark.createDataFrame([(1, 0.8), (2, 0.9), (3, 0.7), (4, 0.99), (5, 0.99), (6, 0.95), (7, 0.2), (8, 1.0)], "id long, similarity double")
    trash = spark.createDataFrame([(6,)], "id long")
    got = lambda **more: [(r.id, r.similarity) for r in se.semantic_search(hits, nodes, trash=trash, **more).collect()]
    assert got() == [(2, 0.9), (3, 0.7), (7, 0.2)] and got(least=0.5) == [(2, 0.9), (3, 0.7)] and got(tag="y") == [(3, 0.7)] and got(limit=1) == [(2, 0.9)]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.25 * rng.normal(size=16)).tolist(), f"t{i % 5}") for i in range(3000)]
    rows += [(5000, None, "t1"), (5001, [0.0] * 16, "t1"), (5002, [1.0] * 15, "t1"), (5003, [float("nan")] * 16, "t1"), (5004, rows[0][1], "t0")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, tag string")
    index = vx.store(spark, f"file://{tmp_path_factory.mktemp('vx')}/index")
    vx.build(index, df, 16)
    return df, index


def test_indexed_search_is_exact_and_reads_a_part(spark, clustered):
    df, index = clustered
    fine = df.filter("id < 5000 OR id = 5004")
    assert index.read("cells").selectExpr("sum(n)").first()[0] == 3001
    for query in (df.first().vector, [0.5] * 16, [(-1.0) ** i for i in range(16)]):
        want = [tuple(r) for r in se.nearest(fine, query, "id", "vector").collect()]
        assert [tuple(r) for r in vx.search(index, query).collect()] == want
        tagged = [tuple(r) for r in se.nearest(fine.filter("tag = 't2'"), query, "id", "vector").collect()]
        assert [tuple(r) for r in vx.search(index, query, tag="t2").collect()] == tagged
    files = vx.search(index, df.first().vector).inputFiles()
    assert 0 < len(files) < index.read("vectors").rdd.getNumPartitions() or len(files) < len(index.read("vectors").inputFiles()) / 2


def test_recall_of_few_cells(clustered):
    df, index = clustered
    found, read = vx.recall(index, df.filter("id < 3000 AND id % 300 = 0"), probe=3)
    assert found >= 0.9 and read < 0.5


def test_edges(spark, tmp_path):
    index = vx.store(spark, f"file://{tmp_path}/index")
    none = spark.createDataFrame([], "id long, vector array<double>, tag string")
    vx.build(index, none, 4)
    assert vx.search(index, [1.0] * 4).count() == 0
    index = vx.store(spark, f"file://{tmp_path}/one")
    vx.build(index, spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], None)] * 3, "id long, vector array<double>, tag string"), 4)
    assert [tuple(r) for r in vx.search(index, [1.0] * 4).collect()] == [(1, 0.5)] * 3


def test_drawn_vectors_are_those_of_the_smallest_hashes(spark):
    from nodeloom.operators import vectors as vx

    rows = spark.range(3000).selectExpr("id", "array(double(id), 1.0D) AS vector").repartition(7)
    every = [r.id for r in rows.selectExpr("id", "xxhash64(5, id) AS h").orderBy("h", "id").collect()]
    for most in (1, 100, 2999, 3000, 5000):
        assert [r.id for r in vx.drawn_by_hash(rows, 3000, most).collect()] == every[:most]
        assert [r.id for r in vx.drawn_by_hash(rows, 300_000, most).collect()] == every[:most]  # too few below the bound


def test_buckets_grow_with_the_texts():
    from nodeloom.operators import fulltext as ft

    assert [ft.buckets_for(n) for n in (0, 4_000_000, 4_000_001, 27_000_000)] == [16, 16, 17, 108]
