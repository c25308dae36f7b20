"""Declared schemas, nested texts and transcripts of exports."""

from nodeloom.operators import graph
from nodeloom.operators import schema as sc
from nodeloom.sources import export_json as ex
from nodeloom.sources import export_schema as es
from nodeloom.sources import export_transcripts as et


def doc(i, name=None, owner=None, kind=None, children=(), source=None, **more):
    return (i, (1, name, owner, kind, None, source, more.get("description"), None), list(children), "2")


def frame(spark, docs):
    return spark.createDataFrame(docs, ex.DOC)


SCHEMA = [
    doc("task", "Task", None, "tagDef", ["d1", "d2", "d3", "d4", "d5"], description="to do"), doc("tm", None, "task", "metanode", ["tt"]), doc("tt", None, "tm", "tuple", ["SYS_A13", "SYS_T01", "item", "none"]),
    doc("item", "item", None, "tagDef", ["i1"]), doc("d1", None, "task", "tuple", ["L1", "v0"]), doc("d2", None, "task", "tuple", ["SYS_A61"]), doc("d3", None, "task", "tuple", ["SYS_A99"]), doc("d4", None, "task", "tuple", ["L2"]), doc("d5", "text", "task", None, []),
    doc("i1", None, "item", "tuple", ["L3"]), doc("L1", "Owner", children=["c1", "vals"]), doc("c1", "typeChoice", "L1", "tuple", ["SYS_T06", "SYS_D13"], "SYS_A02"), doc("vals", "Values", "L1", "tuple", ["SYS_X", "o1", "box"]), doc("o1", "one"), doc("box", None, children=["o2", "o3", "SYS_Y"]), doc("o2", "two"), doc("o3", "one"),
    doc("L2", "Start date"), doc("L3", "Remark"), doc("v0", "nobody"),
    doc("bin", "Bin", "deep", "tagDef"), doc("deep", None, "x_TRASH"), doc("x_TRASH", "Trash"),
    doc("n", "node", children=["f1", "f3"]), doc("nm", None, "n", "metanode", ["nt"]), doc("nt", None, "nm", "tuple", ["SYS_A13", "task"]), doc("f1", None, "n", "tuple", ["L3", "w1"]), doc("w1", "2025-01-02"), doc("f3", None, "n", "tuple", ["SYS_A61", "w2"]), doc("w2", "2025-02-03"),
]


def test_declarations(spark):
    cat, d = es.with_schema(frame(spark, SCHEMA))
    assert {(r.tag_id, r.tag, r.key, r.description) for r in d.tags.collect()} == {("task", "Task", "task", "to do"), ("item", "item", "item", None)}
    assert {(r.child_id, r.parent_id) for r in d.parents.collect()} == {("task", "item")}
    assert {(r.tag, r.field, r.label_id, r.field_order, r.default_value) for r in d.fields.collect()} == {("Task", "Owner", "L1", 0, "nobody"), ("Task", "Due Date", "SYS_A61", 1, None), ("Task", "Start date", "L2", 2, None), ("item", "Remark", "L3", 0, None)}
    assert {(r.label_id, r.option) for r in d.options.collect()} == {("L1", "one"), ("L1", "two")}
    assert {(r.field_id, r.tag_id) for r in d.sources.collect()} == {("SYS_A61", "task")}
    # Stated, by mark, by name, and by the values in use.
    assert {(r.tag, r.field, r.kind, r.evidence) for r in es.field_types(d, cat).collect()} == {("Task", "Owner", "reference", "stated"), ("Task", "Due Date", "date", "system"), ("Task", "Start date", "date", "name"), ("item", "Remark", "date", "values")}
    every = {(r.tag, r.field): (r.origin, r.depth) for r in sc.all_fields(cat, es.system_fields(d)).collect()}
    assert every[("Task", "Remark")] == ("Task", 0) and every[("item", "Remark")] == ("item", 0) and every[("Task", "Due Date")] == ("Task", 0)
    assert {(r.field, r.value) for r in cat.fields.filter("id = 'n'").collect()} == {("Remark", "2025-01-02"), ("Due date", "2025-02-03")}


def test_system_fields_are_inherited_last(spark):
    docs = [doc("a", "a", None, "tagDef", ["x"]), doc("x", None, "a", "tuple", ["SYS_A90"]), doc("b", "b", None, "tagDef", ["y"]), doc("y", None, "b", "tuple", ["L"]), doc("L", "Date"), doc("bm", None, "b", "metanode", ["bt"]), doc("bt", None, "bm", "tuple", ["SYS_A13", "SYS_T01", "a"]), doc("c", "c", None, "tagDef"), doc("cm", None, "c", "metanode", ["ct"]), doc("ct", None, "cm", "tuple", ["SYS_A13", "SYS_T01", "a"])]
    cat, d = es.with_schema(frame(spark, docs))
    cat.tag_fields = cat.tag_fields.filter("tag <> 'a'")
    every = {(r.tag, r.field): (r.origin, r.depth) for r in sc.all_fields(cat, es.system_fields(d)).collect()}
    assert every == {("a", "Date"): ("a", 999), ("b", "Date"): ("b", 0), ("c", "Date"): ("a", 999)}


def test_tuples_at_any_depth_and_cycles(spark):
    deep = [doc("n", "node")] + [doc(f"t{i}", None, "n" if i == 0 else f"t{i - 1}", "tuple", ["L", f"t{i + 1}" if i < 40 else "v"]) for i in range(41)] + [doc("L", "F"), doc("v", "value")]
    loop = [doc("p", None, "q", "tuple", ["L", "v"]), doc("q", None, "p", "tuple", ["L", "v"])]
    assert {(r.id, r.field, r.value) for r in ex.build(frame(spark, deep + loop)).fields.collect()} == {("n", "F", "value")}


def test_owners_of_a_few(spark):
    docs = spark.createDataFrame([("a", "b"), ("b", "x_TRASH"), ("x_TRASH", None), ("c", "a"), ("d", "e"), ("e", "d"), ("f", None), ("g", "none")], "id string, owner string")
    few = spark.createDataFrame([("a",), ("c",), ("d",), ("f",), ("g",), ("unknown",)], "id string")
    assert {r.id for r in graph.owner_in_trash(docs, start=few).collect()} == {"a", "c"}
    assert {r.id for r in graph.owner_in_trash(docs, 2, start=few).collect()} == {"a"}
    assert {r.id for r in graph.owner_in_trash(docs).collect()} == {"a", "b", "c"}


def test_made_exports_are_not_one_tasks(spark):
    from nodeloom.queries_export import schema_export
    from nodeloom.queries_ingest import export_of

    sf = "/root/testdata/sf0.001"
    for docs in (schema_export(spark, sf).filter("startswith(id, 'C:')"), export_of(spark.read.parquet(f"{sf}/customer.parquet")).filter("startswith(id, 'c:')")):
        assert docs.selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_climb(spark):
    up = spark.createDataFrame([(i, i - 1 if i else None, i - 1 == 3) for i in range(200)] + [(300, 301, False), (301, 300, False), (400, 999, False)], "id long, parent_id long, hit boolean")
    got = {r.id: (r.ancestor, r.depth) for r in graph.climb(up, 1000).collect()}
    assert got == {i: (3, i - 3) for i in range(4, 200)}
    assert {r.id for r in graph.climb(up, 10).collect()} == set(range(4, 14))
    assert graph.climb(up.limit(0), 5).count() == 0


def test_trash(spark):
    docs = spark.createDataFrame([("a", None, "x_TRASH"), ("b", "a", None), ("c", "b", "z"), ("d", None, "TRASHY"), ("e", None, "d")], "id string, parent_id string, owner string")
    assert sorted(r.id for r in graph.below_trash(docs).collect()) == ["a", "b", "c"]
    assert sorted(r.id for r in graph.owner_in_trash(docs).collect()) == ["a", "d", "e"]


def test_nested_text(spark):
    flat = ex.flatten(frame(spark, [doc("a", "A", children=["c", "b", "none"]), doc("b", "B", children=["d"]), doc("c", "", children=["e"]), doc("d", "D", children=["f"]), doc("e", "E"), doc("f", "F", children=["a"]), doc("z", None)]))
    ids = flat.select("id")
    text = lambda depth: {r.id: r.text for r in ex.nested_text(flat, ids, depth).collect()}
    assert text(0) == {"a": "A", "b": "B", "d": "D", "e": "E", "f": "F"}
    assert text(2)["a"] == "A\nE\nB\nD" and text(1)["a"] == "A\nB" and text(3)["a"] == "A\nE\nB\nD\nF" and text(2)["f"] == "F\nA\nB"


TALK = [
    doc("m1", "Weekly Sync"), doc("mm", None, "m1", "metanode", ["t1"]), doc("t1", None, "mm", "tuple", ["SYS_A199", "v1"]), doc("v1", None, None, "transcript", ["ln1", "lost", "ln2"]),
    doc("ln1", "Discussing the roadmap", None, "transcriptLine"), doc("lm", None, "ln1", "metanode", ["s1", "s2"]), doc("s1", None, "lm", "tuple", ["SYS_A252", "alice"]), doc("s2", None, "lm", "tuple", ["SYS_A254", "z"]), doc("alice", "Alice"), doc("z", "00:10"),
    doc("ln2", "Action items for next week", None, "transcriptLine"), doc("m2", "Deleted", "b_TRASH"), doc("m2m", None, "m2", "metanode", ["t2"]), doc("t2", None, "m2m", "tuple", ["SYS_A199", "v2"]), doc("v2", None, None, "transcript", ["ln3"]), doc("ln3", "the roadmaps", None, "transcriptLine"),
]


def test_transcripts(spark):
    docs = frame(spark, TALK)
    assert [tuple(r) for r in et.meetings(docs).collect()] == [("m1", "Weekly Sync", 1, "v1", 3)]
    got = {(r.line_id, r.position, r.speaker, r.start_time, r.end_time) for r in et.lines(docs).filter("transcript_id = 'v1'").collect()}
    assert got == {("ln1", 0, "Alice", None, "00:10"), ("ln2", 2, None, None, None)}
    assert {(r.line_id, r.speaker, r.meeting) for r in et.search(docs, ["ROADMAP"]).collect()} == {("ln1", "Alice", "Weekly Sync")}
    assert {(r.line_id, r.meeting) for r in et.search(docs, ["roadmap"], whole_words=False).collect()} == {("ln1", "Weekly Sync"), ("ln3", None)}
    assert et.lines(docs.limit(0)).count() == 0


def test_strict_lines(spark, tmp_path):
    import json

    import pytest

    (tmp_path / "x.jsonl").write_text(json.dumps({"id": "a", "props": {"name": "one"}, "children": []}) + "\n{broken\n")
    assert [r.id for r in ex.read_lines(spark, str(tmp_path)).collect()] == ["a"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        ex.read_lines(spark, str(tmp_path), strict=True).collect()


def test_json_array_is_json(spark, tmp_path):
    import json

    from nodeloom.sources import formats

    df = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(40)], "id long, name string").repartition(5)
    for name, rows in (("many", df), ("none", df.limit(0))):
        formats.write(rows, str(tmp_path / name), "json")
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert sorted(x["id"] for x in json.loads(text)) == ([] if name == "none" else list(range(40)))
