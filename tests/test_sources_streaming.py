import json

from nodeloom.operators import incremental as inc
from nodeloom.sources import export_json as ex
from nodeloom.sources import formats
from nodeloom.streaming import feeds
from pyspark.sql import functions as F


def doc(i, name=None, owner=None, kind=None, children=(), **more):
    return {"id": i, "props": {"created": 1700000000000, "name": name, "_ownerId": owner, "_docType": kind}, "children": list(children), **more}


DOCS = [
    doc("task", "task"), doc("taskM", owner="task", kind="metanode"), doc("t1", owner="taskM", kind="tuple", children=["SYS_A13", "SYS_T01", "item"]),
    doc("item", "item"), doc("itemM", owner="item", kind="metanode"), doc("t2", owner="itemM", kind="tuple", children=["SYS_A13", "SYS_T01"]),
    doc("due", "Due"), doc("v1", "2025-01-02"), doc("v2", "2025-01-03"), doc("v0", " "),
    doc("n1", 'See <span data-inlineref-node="n2"></span><span data-inlineref-node="none"></span>', children=["f1", "n2"], modifiedTs=[1700000000001, 5]),
    doc("m1", owner="n1", kind="metanode"), doc("t3", owner="m1", kind="tuple", children=["SYS_A13", "task"]),
    doc("f1", owner="n1", kind="tuple", children=["due", "v1", "v0", "v2"]), doc("n2", "other", modifiedTs="1700000000002"),
    doc("big", owner="n2", kind="tuple", children=["due"] + ["v1"] * 60), doc("TRASH", children=["bin"]), doc("bin", "deleted"),
]


def test_export(spark, tmp_path):
    for name, docs in (("w@2025-01-01.json", DOCS[:3]), ("w@2025-02-01.json", DOCS)):
        (tmp_path / name).write_text(json.dumps({"formatVersion": 1, "docs": docs}))
    path = ex.latest_file(spark, str(tmp_path))
    assert path.endswith("w@2025-02-01.json")
    cat = ex.build(ex.read_docs(spark, path))
    assert {(r.id, r.tag) for r in cat.tags.collect()} == {("n1", "task")}
    assert [(r.child, r.parent) for r in cat.tag_parents.collect()] == [("task", "item")]
    values = cat.fields.orderBy("value_order").collect()
    assert [(r.id, r.field, r.value, r.value_order) for r in values] == [("n1", "Due", "2025-01-02", 0), ("n1", "Due", "2025-01-03", 1)]
    assert {(r.source, r.target) for r in cat.links.filter("kind = 'inline_ref'").collect()} == {("n1", "n2")}
    nodes = {r.id: r for r in cat.nodes.collect()}
    assert "bin" not in nodes and "TRASH" not in nodes and nodes["n2"].parent_id == "n1"
    assert (nodes["n1"].updated, nodes["n2"].updated) == (1700000000001, 1700000000002)
    assert [(r.tag, r.field, r.kind) for r in cat.tag_fields.collect()] == [("task", "Due", "date")]
    assert [r.line for r in formats.mermaid(cat).collect()] == ["graph BT", "  task --> item"]
    assert [r.line for r in formats.dot(cat).collect()] == ["digraph tags {", '  "task" -> "item";', "}"]


def test_seeds(spark, tmp_path):
    item = {"id": "a", "content": "x", "confirmedAt": "2025-01-01T00:00:00Z", "confirmed": True, "tags": ["t"]}
    (tmp_path / "seed.json").write_text(json.dumps({"learned": {"patterns": [item], "insights": [], "selfKnowledge": [dict(item, id="b", confirmedAt=None, confirmed=False)]}}))
    assert [(r.category, r.id, r.confirmed) for r in ex.read_seeds(spark, str(tmp_path / "seed.json")).orderBy("id").collect()] == [("patterns", "a", True), ("selfKnowledge", "b", False)]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y', None)], "id string, name string, tags string")
    for kind in formats.FORMATS:
        formats.write(df.coalesce(1), str(tmp_path / kind), kind)
    read = lambda k: next((tmp_path / k).glob("part-*")).read_text().splitlines()
    assert read("csv") == ["id,name,tags", 'a,"say ""x"", y",']
    assert read("ids") == ["a"]
    assert json.loads(read("minimal")[0]) == {"id": "a", "name": 'say "x", y'}


SCHEMA = "id string, name string, updated long, tags array<string>"


def write_changes(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"c{number}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_change_feed(spark, tmp_path):
    changes, target, events = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "e")
    change = lambda i, name, at, *tags: {"id": i, "name": name, "updated": at, "tags": list(tags)}

    def run():
        feeds.sync(feeds.read_changes(spark, str(changes), SCHEMA), target, SCHEMA, "id", ["updated"], str(tmp_path / "c"), feeds.append_events(events)).awaitTermination()
        return {r.id: (r.name, r.tags) for r in feeds.read_current(spark, target, SCHEMA).collect()}

    write_changes(changes, 1, [change("a", "one", 1, "x"), change("b", "two", 1), change("a", "uno", 2, "y"), "{broken"])
    assert run() == {"a": ("uno", ["y"]), "b": ("two", [])}
    write_changes(changes, 2, [change("b", "zwei", 3, "z"), change("c", "drei", 3)])
    assert run() == {"a": ("uno", ["y"]), "b": ("zwei", ["z"]), "c": ("drei", [])}
    assert run() == {"a": ("uno", ["y"]), "b": ("zwei", ["z"]), "c": ("drei", [])}
    got = {(r.batch, r.type, r.id, r.added) for r in spark.read.json(events).collect()}
    assert got == {(0, "create", "a", "y"), (0, "create", "b", ""), (1, "modify", "b", "z"), (1, "create", "c", "")}


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    changes, target = tmp_path / "in", str(tmp_path / "t")
    row = lambda i, at: {"id": i, "name": f"n{at}", "updated": at, "tags": []}

    def run():
        feeds.sync(feeds.read_changes(spark, str(changes), SCHEMA), target, SCHEMA, "id", ["updated"], str(tmp_path / "c")).awaitTermination()
        return {r.id: r.name for r in feeds.read_current(spark, target, SCHEMA).collect()}

    write_changes(changes, 0, ["{broken"])
    assert run() == {}
    write_changes(changes, 1, [row(f"k{i}", 1) for i in range(300)])
    assert len(run()) == 300
    write_changes(changes, 2, [row("k7", 2)])
    assert {k: v for k, v in run().items() if v == "n2"} == {"k7": "n2"} and len(run()) == 300
    files = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert len({p.parent for p in files if "v=2" in str(p)}) == 1 < len({p.parent for p in files if "v=1" in str(p)})


def test_lines_and_wrapped_exports(spark, tmp_path):
    doc = {"id": "a", "props": {"name": "one", "created": 1}, "children": ["b"]}
    (tmp_path / "w@2025-01-01.json").write_text(json.dumps({"storeData": {"docs": [doc]}}))
    (tmp_path / "p@2025-01-02.json").write_text(json.dumps({"formatVersion": 1, "docs": [{**doc, "id": "c"}]}))
    assert {r.id for r in ex.read_docs(spark, str(tmp_path)).collect()} == {"a", "c"}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.jsonl").write_text(json.dumps(doc) + "\n{broken\n" + json.dumps({**doc, "id": "d"}))
    got = ex.read_lines(spark, str(tmp_path / "lines"))
    assert {r.id for r in got.collect()} == {"a", "d"}
    assert ex.build(got).nodes.count() == 2


def test_windowed_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = feeds.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(feeds.windowed_counts(table, "ts", "event_type"))


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "x", 1, ["t"]), ("b", "y", 1, []), ("c", "z", 1, None)], SCHEMA)
    new = spark.createDataFrame([("a", "x", 2, ["u"]), ("b", "y", 1, []), ("d", "w", 1, [])], SCHEMA)
    got = {(r.type, r.id, r.added, r.removed) for r in inc.snapshot_diff(old, new).collect()}
    assert got == {("modify", "a", "u", "t"), ("delete", "c", "", ""), ("create", "d", "", "")}
    assert {(r.id, r.change) for r in inc.checksum_diff(old, new, "id", ["name"]).collect()} == {("c", "deleted"), ("d", "added")}
    assert inc.replace_groups(old, new, "id").count() == 4


def test_saved_catalog(spark, tmp_path):
    from nodeloom import catalog
    from nodeloom.operators import query
    from nodeloom.plans.predicates import Where
    from nodeloom.sources import tables

    cat = catalog.star_catalog(spark, "/root/testdata/sf0.001")
    tables.save_catalog(cat, str(tmp_path / "cat"))
    saved = tables.load_catalog(spark, str(tmp_path / "cat"), catalog.PRIMARY)
    find = lambda c: query.find(c, "order", [Where("Status", "=", "F")])
    assert sorted(find(saved).collect()) == sorted(find(cat).collect())
    assert "PartitionFilters: [isnotnull(tag" in find(saved)._jdf.queryExecution().toString()
