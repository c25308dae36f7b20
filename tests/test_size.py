"""Work is dealt over the tasks of a shuffle, and done once, however the input grows."""

from nodeloom import catalog
from nodeloom.operators import aggregate, incremental, query, schema
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_values_of_an_attribute_stay_dealt_over_all_tasks(spark):
    """Joined rows are not gathered in as few tasks as there are cores."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cat = catalog.star_catalog(spark, SF)
        keyed = aggregate.group_key(cat, query.find(cat, "order").select("id", "created"), "Part", "g0")
        used = keyed.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(used) >= 4 and max(r.n for r in used) < sum(r.n for r in used) / 2


def test_audit_reads_the_tables_of_nodes_once(spark):
    """Detectors start from written tables of a schema's size."""
    files = schema.audit(catalog.star_catalog(spark, SF)).inputFiles()
    assert files and not [f for f in files if f.startswith(f"file://{SF}")]


def test_fill_rates_by_bits(spark):
    """More attributes than one number has bits for, repeated tags and values, empty values, values without a tag."""
    empty = lambda ddl: spark.createDataFrame([], ddl)
    names = [f"f{i:03}" for i in range(130)]
    values = [(f"n{k}", f, "x", 0, None) for k in range(4) for i, f in enumerate(names) if i % (k + 1) == 0]
    values += [("n1", "f001", "", 0, None), ("n0", "f000", "y", 1, None), ("lost", "f001", "x", 0, None), ("n0", "undeclared", "x", 0, None), ("m", "f129", "x", 0, None)]
    cat = catalog.Catalog(
        empty("id string, name string, parent_id string, created long, updated long, tag string"),
        spark.createDataFrame([(f"n{k}", "t") for k in range(4)] + [("n0", "t"), ("n0", "u"), ("m", "u")], "id string, tag string"),
        spark.createDataFrame(values, "id string, field string, value string, value_order int, value_id string"),
        empty("source string, target string, kind string"),
        empty("child string, parent string"),
        spark.createDataFrame([("t", f, i, "text") for i, f in enumerate(names)] + [("u", "f129", 0, "text"), ("none", "f001", 0, "text")], "tag string, field string, field_order int, kind string"),
    )
    got = {(r.tag, r.field): (r.filled, r.instances, r.rate) for r in schema.fill_rates(cat).collect()}
    want = {("t", f): (n := sum(i % (k + 1) == 0 for k in range(4)), 4, n * 25.0) for i, f in enumerate(names)}
    assert got == want | {("u", "f129"): (2, 2, 100.0)}


def test_changes_are_dealt_out_before_they_are_sorted(spark):
    """The latest change of each key is not sought within one file's task first."""
    changes = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    last = incremental.last_per_key(changes, "user_id", ["ts", "event_id"])
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("Aggregate")
    assert last.count() == changes.select("user_id").distinct().count()
