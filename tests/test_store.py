"""Versioned buckets, upkeep of an index and of postings, and feeds whose batches are out of order."""

import json

import pytest
from nodeloom.operators import fulltext as ft
from nodeloom.operators import incremental as inc
from nodeloom.sources import export_json as ex
from nodeloom.sources.store import KEEP, Store, Table
from nodeloom.streaming import feeds
from pyspark.sql import functions as F

SCHEMA = "k long, v string, bucket int"


def store_of(spark, tmp_path, buckets=64):
    return Store(spark, f"file://{tmp_path}/store", {"t": Table(SCHEMA, ("k",), buckets), "u": Table("k long", ("k",), 4)})


def rows(spark, *of):
    return spark.createDataFrame([(k, f"v{k}", k * 7) for k in of], SCHEMA)


def keys(store, table="t", **more):
    return sorted(r.k for r in store.read(table, **more).collect())


def test_a_bucket_that_loses_its_last_row(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.commit(0, {"t": (rows(spark, *range(6)), None)})
    store.replace(1, {"t": (rows(spark, 3).select("k"), rows(spark).limit(0), ["k"])})
    assert keys(store) == [0, 1, 2, 4, 5] and keys(store, below=1) == list(range(6))
    assert {(r.k, r.v, r.bucket) for r in store.read("t").collect()} == {(k, f"v{k}", k * 7) for k in (0, 1, 2, 4, 5)}


def test_the_index_reads_itself(spark, tmp_path):
    store = store_of(spark, tmp_path, 4)
    store.commit(0, {"t": (rows(spark, *range(50)), None)})
    for version in range(1, 5):
        old = store.read("t")
        store.commit(version, {"t": (old.withColumn("v", F.concat("v", F.lit("!"))), None)})
    assert {r.v for r in store.read("t").collect()} == {f"v{k}!!!!" for k in range(50)}


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.commit(0, {"t": (rows(spark, 1), None), "u": (rows(spark, 1).select("k"), None)})
    broken = rows(spark, 2).select(F.raise_error(F.lit("lost")).cast("long").alias("k"))
    with pytest.raises(Exception, match="lost"):
        store.commit(1, {"t": (rows(spark, 2), None), "u": (broken, None)})
    assert keys(store) == keys(store, "u") == [1] and store.versions() == [0]
    store.commit(1, {"t": (rows(spark, 2), None), "u": (rows(spark, 2).select("k"), None)})
    store.commit(1, {"t": (rows(spark, 2), None), "u": (rows(spark, 2).select("k"), None)})  # tried again
    assert keys(store) == keys(store, "u") == [2]


def test_old_versions_go(spark, tmp_path):
    store = store_of(spark, tmp_path, 8)
    store.commit(0, {"t": (rows(spark, *range(40)), None)})
    for version in range(1, 6):
        store.replace(version, {"t": (rows(spark, 7).select("k"), rows(spark, 7), ["k"])})
    assert store.versions() == [4, 5] and len(store.versions()) == KEEP and keys(store) == list(range(40))
    folders = {p.parent.parent.name for p in (tmp_path / "store" / "data" / "t").rglob("*.parquet")}
    assert folders == {"v=0", "v=4", "v=5"}
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) == KEEP


def doc(i, name=None, owner=None, kind=None, children=()):
    return {"id": i, "props": {"created": 1, "name": name, "_ownerId": owner, "_docType": kind}, "children": list(children), "modifiedTs": "2"}


TAG = [doc("task", "task"), doc("tm", owner="task", kind="metanode"), doc("tt", owner="tm", kind="tuple", children=["SYS_A13", "SYS_T01"]), doc("L", "Due")]


def export(spark, tmp_path, name, items):
    """An export of ``items``: id to (name, value or None)."""
    docs = list(TAG)
    for i, (text, value) in items.items():
        docs += [doc(i, text, children=[f"f{i}"]), doc(f"m{i}", owner=i, kind="metanode"), doc(f"g{i}", owner=f"m{i}", kind="tuple", children=["SYS_A13", "task"])]
        docs += [doc(f"f{i}", owner=i, kind="tuple", children=["L", f"v{i}"]), doc(f"v{i}", value)] if value else []
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(map(json.dumps, docs)))
    return ex.build(ex.read_lines(spark, str(path)))


def tables_of(read):
    return {name: sorted(map(str, map(tuple, read(name).collect()))) for name in inc.INDEX}


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    versions = [
        {f"n{i}": (f"Name {i}", f"2025-01-{i:02d}") for i in range(1, 13)},
        {f"n{i}": (f"Name {i}" if i != 4 else "Other words", f"2025-01-{i:02d}" if i != 5 else "2030-05-05") for i in range(1, 13) if i not in (2, 9)} | {"n20": ("Name new", None)},
        {},
    ]
    store = inc.index_store(spark, f"file://{tmp_path}/index", 32)
    for k, items in enumerate(versions):
        cat = export(spark, tmp_path, f"e{k}", items)
        found = {(r.owner, r.part, r.change) for r in inc.update_index(store, cat).collect()}
        fresh = inc.index_store(spark, f"file://{tmp_path}/fresh{k}", 32)
        inc.update_index(fresh, cat)
        assert tables_of(store.read) == tables_of(fresh.read)
        for table in ft.tables(32):
            strip = lambda df: sorted(str(tuple(r)) for r in df.collect())
            assert strip(store.read(table)) == strip(fresh.read(table))
        hits = lambda s, q: [(r.id, r.score) for r in ft.search(s, q).collect()]
        assert hits(store, "name") == hits(fresh, "name") and hits(store, "other WORDS") == hits(fresh, "other WORDS")
        if k == 1:
            assert {("n2", "nodes", "deleted"), ("n4", "nodes", "modified"), ("n5", "fields", "modified"), ("n20", "tags", "added")} <= found
            assert ("n4", "tags", "modified") not in found and ("n1", "fields", "modified") not in found
            assert [i for i, _ in hits(store, "words other")] == ["n4"] and "n2" not in {i for i, _ in hits(store, "name")}
        before = store.versions()
        assert inc.update_index(store, cat).count() == 0 and store.versions() == before
    assert inc.stored_catalog(store).nodes.count() == len(TAG)


def test_an_export_that_is_the_last_one_is_only_read(spark, tmp_path):
    rows = lambda *docs: spark.read.schema(ex.DOC).json(spark.sparkContext.parallelize([json.dumps(d) for d in (*TAG, *docs)]))
    store = inc.index_store(spark, f"file://{tmp_path}/index", 8)
    assert inc.update_export(store, rows(doc("a", "one"), doc("b", "two"))).count() > 0 and store.versions() == [0]
    assert inc.update_export(store, rows(doc("b", "two"), doc("a", "one"))).count() == 0 and store.versions() == [0]
    changed = {tuple(r) for r in inc.update_export(store, rows(doc("a", "one"), doc("b", "three"))).collect()}
    assert changed == {("b", "nodes", "modified")} and store.versions() == [0, 1]
    assert [r.id for r in ft.search(store, "three").collect()] == ["b"] and ft.search(store, "two").count() == 0


TEXTS = [("a", "the red house", 10, None), ("b", "The RED red fox", 20, 5), ("c", None, 30, 6), ("d", "red", None, None), ("e", "a house; the red-house", 40, 9)]
TEXT = "id string, text string, created long, updated long"


def test_stored_search_reads_its_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/fts", ft.tables(16))
    docs = spark.createDataFrame(TEXTS, TEXT)
    ft.update(store, docs, docs)
    found = lambda q, **more: [r.id for r in ft.search(store, q, **more).collect()]
    from nodeloom.operators import search as se

    want = [(r.id, r.score) for r in se.bm25(docs, ["red", "house"]).collect()]
    assert [(r.id, r.score) for r in ft.search(store, "House red!").collect()] == want
    assert found("red", created_after=10, created_before=40) == ["b"] and found("red", updated_after=4, updated_before=9) == ["b"]
    assert found("none") == found("red none") == found("") == []
    assert sorted(found('"red house"')) == ["a", "e"]
    assert found("red-house") == found('"red house"') and found('"the red" fox') == ["b"] and found('"house red"') == [] and found('"red red fox"') == ["b"]
    files = ft.search(store, "fox").inputFiles()
    assert files and all("/postings/" in f for f in files) and len({f.rsplit("/", 2)[1] for f in files}) == 1
    ft.update(store, docs.filter("id IN ('a', 'b')"), docs.filter("id = 'a'").withColumn("text", F.lit("blue")))
    assert found("red") == ["d", "e"] and found("blue") == ["a"] and found("fox") == []
    assert store.read("corpus").first()[1:] == (4, 7) and {r.term: r.df for r in store.read("terms").collect()} == {"blue": 1, "red": 2, "a": 1, "house": 1, "the": 1}


def test_frequent_terms_are_dealt_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ft, "SLICE", 10)
    store = Store(spark, f"file://{tmp_path}/fts", ft.tables(64))
    docs = spark.createDataFrame([(f"d{i}", "common word" if i % 2 else "common", 1, 1) for i in range(95)], TEXT)
    ft.update(store, docs, docs)
    assert {r.term: r.slices for r in store.read("terms").collect()} == {"common": 10, "word": 5}
    assert ft.search(store, "common word", None).count() == 47
    ft.update(store, docs, docs.limit(0))
    assert ft.search(store, "common").count() == 0 and store.read("postings").count() == 0


def feed(spark, tmp_path, name, batches, schema):
    folder = tmp_path / name
    folder.mkdir()
    for k, batch in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
    import os

    for k in range(len(batches)):
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return feeds.read_changes(spark, str(folder), schema, files_per_batch=1)


CHANGE = "k long, at long, v string, bucket string"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_batches_out_of_order_equal_one_batch(spark, tmp_path, order):
    batches = [
        [{"k": 1, "at": 20, "v": "new", "bucket": "x"}, {"k": 2, "at": 5, "v": "b"}, {"k": 3, "at": 1, "v": "c"}],
        [{"k": 1, "at": 10, "v": "old"}, {"k": 2, "at": 9, "v": "gone", "gone": True}, {"k": 4, "at": 1, "v": "d"}],
        [{"k": 2, "at": 7, "v": "late"}, {"k": 3, "at": 2, "gone": True}, {"k": 3, "at": 3, "v": "back"}, {"k": 4, "at": 1, "v": "e"}],
    ]
    many = feed(spark, tmp_path, "many", [batches[i] for i in order], CHANGE + ", gone boolean")
    one = feed(spark, tmp_path, "one", [sum(batches, [])], CHANGE + ", gone boolean")
    got = []
    for name, changes in (("many", many), ("one", one)):
        feeds.sync(changes, f"file://{tmp_path}/{name}-t", CHANGE, "k", ["at"], str(tmp_path / f"{name}-c"), deleted="gone").awaitTermination()
        got.append(sorted(str(tuple(r)) for r in feeds.read_current(spark, f"file://{tmp_path}/{name}-t", CHANGE).collect()))
    assert got[0] == got[1] == sorted(["(1, 20, 'new', 'x')", "(3, 3, 'back', None)", "(4, 1, 'e', None)"])


def test_feed_of_nodes(spark, tmp_path):
    def node(i, at, name, tags=(), fields=(), **more):
        return {"id": i, "name": name, "updated": at, "tags": list(tags), "fields": [{"field": f, "value": v} for f, v in fields], **more}

    batches = [
        [node("a", 5, "A", ["x", "y"], [("F", "1"), ("F", "2"), ("G", " ")]), node("b", 1, "B", ["x"])],
        [node("a", 3, "late", ["z"], [("H", "9")]), node("b", 2, "B2", [], [("F", "7")])],
        [node("b", 3, None, deleted=True), node("c", 1, "C", ["x", "x"])],
    ]
    changes = feed(spark, tmp_path, "in", batches, feeds.NODE_CHANGE)
    feeds.sync_nodes(changes, f"file://{tmp_path}/t", str(tmp_path / "c")).awaitTermination()
    store = feeds.node_store(spark, f"file://{tmp_path}/t")
    assert {(r.id, r.name, tuple(r.tags)) for r in feeds.snapshot(spark, f"file://{tmp_path}/t").collect()} == {("a", "A", ("x", "y")), ("c", "C", ("x",))}
    assert {(r.id, r.field, r.value, r.value_order) for r in store.read("fields").collect()} == {("a", "F", "1", 0), ("a", "F", "2", 1)}
    assert tuple(store.read("progress").first()) == ("feed", 5, 5)


def test_the_newest_export_is_applied(spark, tmp_path):
    for day in ("2025-01-01", "2025-03-01", "2025-02-01"):
        (tmp_path / f"w@{day}.json").write_text(json.dumps({"docs": [doc(day, day)]}))
    seen = []
    apply = lambda cat, number: seen.append([r.id for r in cat.nodes.collect()])
    feeds.on_new_export(spark, str(tmp_path), apply, str(tmp_path / "c")).awaitTermination()
    assert seen == [["2025-03-01"]]
    (tmp_path / "w@2025-04-01.json").write_text(json.dumps({"docs": [doc("x", "x")]}))
    feeds.on_new_export(spark, str(tmp_path), apply, str(tmp_path / "c")).awaitTermination()
    assert seen == [["2025-03-01"], ["x"]]
