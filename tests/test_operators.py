from datetime import datetime, timezone

import pytest
from nodeloom.catalog import Catalog
from nodeloom.functions import dates
from nodeloom.functions import text as tx
from nodeloom.operators import graph, query, schema, search
from nodeloom.plans.predicates import Where, apply
from pyspark.sql import functions as F

T = datetime(2025, 6, 15, 12, tzinfo=timezone.utc)
MS = int(T.timestamp() * 1000)
DAY = 86_400_000


@pytest.fixture(scope="module")
def cat(spark):
    nodes = [("task1", "Fix login bug", "project1", MS - 7 * DAY, MS), ("task2", "Write tests", "project1", MS - 30 * DAY, MS - 7 * DAY), ("task3", "Deploy to prod", "project2", MS, None), ("project1", "Auth Project", None, MS - 30 * DAY, MS), ("project2", "Infra Project", None, MS - 30 * DAY, None), ("meeting1", "Standup", None, MS, None), ("x_TRASH", "bin", None, MS, None), ("old", "gone", "x_TRASH", MS, None)]
    tags = [("task1", "task"), ("task2", "task"), ("task3", "task"), ("project1", "project"), ("project2", "project"), ("meeting1", "meeting")]
    fields = [("task1", "Status", "Active", 0, None), ("task2", "Status", "Done", 0, None), ("task3", "Status", "Active", 0, None), ("task1", "Priority", "3", 0, None), ("task2", "Priority", "1", 0, None), ("task1", "State", '<span data-color="blue">DONE</span>', 0, None), ("task1", "Description", "", 0, None), ("meeting1", "About", "task1", 0, "task1"), ("meeting1", "About", "task2", 1, "task2")]
    links = [("task1", "project1", "parent"), ("project1", "task1", "child"), ("task1", "task2", "inline_ref"), ("task2", "task1", "inline_ref")]
    return Catalog(
        spark.createDataFrame([(*n, "node") for n in nodes], "id string, name string, parent_id string, created long, updated long, tag string"),
        spark.createDataFrame(tags, "id string, tag string"),
        spark.createDataFrame(fields, "id string, field string, value string, value_order int, value_id string"),
        spark.createDataFrame(links, "source string, target string, kind string"),
        spark.createDataFrame([("task", "item"), ("item", "thing"), ("thing", "task"), ("bug", "task")], "child string, parent string"),
        spark.createDataFrame([("task", "Status", 0, "options"), ("item", "Status", 0, "text"), ("thing", "Size", 0, "number")], "tag string, field string, field_order int, kind string"),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "where,want",
    [
        (Where("Priority", "empty"), ["task3"]),
        (Where("Description", "empty"), ["task1", "task2", "task3"]),
        (Where("Priority", "empty", negate=True), ["task1", "task2"]),
        (Where("State", "=", "done"), ["task1"]),
        (Where("Status", "=", "Done", negate=True), ["task1", "task3"]),
        (Where("Status", "!=", "Done"), ["task1", "task3"]),
        (Where("created", ">", "8d"), ["task1", "task3"]),
        (Where("parent.name", "~", "AUTH"), ["task1", "task2"]),
        (Where("parent.tags", "=", "project"), ["task1", "task2", "task3"]),
    ],
)
def test_predicates(cat, where, want):
    assert ids(query.find(cat, "task", [where], T)) == want


def test_combined_and_paging(cat):
    assert ids(query.find(cat, "task", [Where("Status", "=", "Active"), Where("Priority", ">=", 2)])) == ["task1"]
    rows = query.order(cat, query.find(cat, "task"), "Priority", numeric=True)
    assert [r.id for r in rows.collect()] == ["task1", "task2", "task3"]
    assert query.has_more(rows, 2) and not query.has_more(rows, 3)
    for bad in (lambda: query.page(rows, 0), lambda: query.page(rows, 1001), lambda: query.page(rows, 5, -1), lambda: query.run(cat, " ")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Where("a", "like", "b")
    assert apply(cat, cat.nodes.limit(0), [Where("Status", "=", "x")]).count() == 0


def test_traversal(cat, spark):
    start = spark.createDataFrame([("task1",)], "id string")
    assert ids(graph.traverse(cat, start, "out", depth=1)) == ["project1", "task2"]
    both = {r.id: r.distance for r in graph.traverse(cat, start, "both", depth=3).collect()}
    assert both == {"project1": 1, "task2": 1, "meeting1": 1}
    with pytest.raises(ValueError):
        graph.traverse(cat, start, depth=0)
    assert {(r.id, r.ancestor) for r in graph.nearest_ancestor(cat, cat.nodes.select("id"), ["project"]).collect()} == {("task1", "project1"), ("task2", "project1"), ("task3", "project2"), ("project1", "project1"), ("project2", "project2")}
    assert ids(graph.in_trash(cat, cat.nodes.select("id"))) == ["old", "x_TRASH"]


def test_inheritance_with_a_cycle(cat):
    up = {(r.tag, r.ancestor): r.depth for r in schema.ancestors(cat).collect()}
    assert up[("bug", "thing")] == 3 and up[("task", "thing")] == 2 and ("task", "task") not in up
    fields = {(r.tag, r.field): r.origin for r in schema.all_fields(cat).collect()}
    assert fields[("bug", "Status")] == "task" and fields[("item", "Status")] == "item"
    assert schema.audit(cat).count() > 0


def test_resolution(spark):
    nodes = spark.createDataFrame([("n1", "Daniel Miller"), ("n2", "Daniel Fischer"), ("n3", "Project Alpha")], "id string, name string")
    asked = spark.createDataFrame([("Daniel Miler",), ("daniel miller",), ("zzzz",)], "query string")
    got = {r.query: (r.action, r.id) for r in search.resolve(search.fuzzy_matches(asked, nodes)).collect()}
    assert got == {"Daniel Miler": ("matched", "n1"), "daniel miller": ("matched", "n1")}


@pytest.mark.parametrize("period,want", [("hour", "2025-06-15T14:00:00"), ("day", "2025-06-15"), ("week_iso", "2025-W24"), ("month", "2025-06"), ("quarter", "2025-Q2"), ("year", "2025")])
def test_buckets(spark, period, want):
    at = int(datetime(2025, 6, 15, 14, 30, 45, tzinfo=timezone.utc).timestamp() * 1000)
    assert spark.range(1).select(dates.bucket(F.lit(at), period)).first()[0] == want


def test_bucket_sequence_and_weeks(spark):
    d = lambda s: F.lit(s).cast("date")
    assert len(spark.range(1).select(dates.buckets_between(d("2025-01-31"), d("2025-04-01"), "month")).first()[0]) == 4
    at = int(datetime(2025, 12, 29, tzinfo=timezone.utc).timestamp() * 1000)
    assert spark.range(1).select(dates.bucket(F.lit(at), "week_iso"), dates.bucket(F.lit(at), "week")).first()[:] == ("2026-W01", "2025-W52")
    assert dates.resolve_date("1m", datetime(2025, 3, 31, 5, tzinfo=timezone.utc)) == int(datetime(2025, 2, 28, tzinfo=timezone.utc).timestamp() * 1000)


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.decode_entities(F.lit("&amp;lt; &lt;b&gt;"))) == "&lt; <b>"
    assert one(tx.normalize_name(F.lit("Meeting - Notes_1!"))) == "meetingnotes1"
    assert one(tx.number_prefix(F.lit("12abc"))) == 12.0 and one(tx.number_prefix(F.lit("abc"))) is None
    assert one(tx.mentions(F.lit('"a b" and "Cat Dog" with Ann Lee @bob #tag @bob'))) == ["Cat Dog", "Ann Lee", "bob", "tag"]
    assert one(tx.mentions(F.lit("The Plan of Jens-Christian Fischer @x_y-1 #ab"))) == ["Jens-Christian Fischer", "x_y-1"]
    # Only blanks are trimmed, whatever the place of a name, and a line's begin is none behind a phrase that took the break.
    assert one(tx.mentions(F.lit("x@mail0.example.com y@mail1.example.com"))) == ["mail0", "mail1"]
    assert one(tx.mentions(F.lit("Foo Bar Baz Qux\nAbc Def"))) == ["Foo Bar Baz Qux"]
    assert one(tx.enriched(F.array(F.lit("t")), F.array(F.struct(F.lit("F").alias("field"), F.lit("v" * 60).alias("value"))), F.lit("n"))) == "[Type: #t] [F: " + "v" * 50 + "…] n"


def test_budget_prunes_before_it_collects(spark, monkeypatch):
    import random

    from nodeloom.operators.search import within_budget
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"i{i}", rng.randrange(50) / 50, rng.choice([0, 1, 2, 3, 7, 20, 45, 200])) for i in range(1500)]
    out = within_budget(spark.createDataFrame(rows, "grp string, id string, score double, tokens long"), 100, "grp")
    want = set()
    for g in "ab":
        used, ids = 0, []
        for _, i, t in sorted((-s, i, t) for x, i, s, t in rows if x == g):
            if used + t <= 100:
                used += t
                ids.append(i)
        want |= {(g, used, k, i) for k, i in enumerate(ids)}
    assert {tuple(r) for r in out.select("grp", "used", "position", "id").collect()} == want
    # One hot group: what its array holds is bounded by the budget, not by its rows.
    hot = spark.range(20_000).select(F.lit("g").alias("grp"), F.col("id").cast("string").alias("id"), F.rand(1).alias("score"), (F.col("id") % 50 + 1).alias("tokens"))
    gathered = []
    real = F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: gathered.append(c) or F.when(F.count("*") > 100 * 6, F.raise_error(F.lit("too many"))).otherwise(real(c)))
    assert len(within_budget(hot, 100, "grp").collect()) > 2 and gathered
