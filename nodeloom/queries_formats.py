"""Queries on formats, sinks, ranges, trash, attachments and small sources, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import millis
from .functions import dates
from .functions import text as tx
from .operators import aggregate as ag
from .operators import attachments as at
from .operators import graph as gr
from .operators import incremental as inc
from .operators import query as q
from .operators import schema as sc
from .operators import search as se
from .queries import _USES, EVENTS_FROM, EVENTS_TO, ORACLE_SQL, QUERIES, star, table
from .queries_export import _at, _node, export
from .sources import export_json as ex
from .sources import formats as fm
from .storage import materialize, shared_dir
from .streaming import feeds

# Dates, numbers and ranges

_AGO = f"({EVENTS_TO} - ms)"


@table(f"""SELECT event_id, strftime(ts, '%b %-d, %Y') AS human, CASE WHEN {_AGO} < 60000 THEN 'just now' WHEN {_AGO} < 3600000 THEN CASE WHEN {_AGO} // 60000 = 1 THEN '1 minute ago' ELSE {_AGO} // 60000 || ' minutes ago' END
WHEN {_AGO} < 86400000 THEN CASE WHEN {_AGO} // 3600000 = 1 THEN '1 hour ago' ELSE {_AGO} // 3600000 || ' hours ago' END WHEN {_AGO} < 8 * 86400000 THEN CASE WHEN {_AGO} // 86400000 = 1 THEN 'yesterday' ELSE {_AGO} // 86400000 || ' days ago' END ELSE strftime(ts, '%Y-%m-%d') END AS relative
FROM (SELECT event_id, ts, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 <= {EVENTS_TO})""")
def date_formats(t):
    e = t("events").select("event_id", millis("ts").alias("ms")).filter(F.col("ms") <= EVENTS_TO)
    return e.select("event_id", dates.human_date(F.col("ms")).alias("human"), dates.relative_date(F.col("ms"), EVENTS_TO).alias("relative"))


@table("SELECT l_orderkey, l_linenumber, (l_discount * 100)::int || '.0%' AS discount FROM lineitem")
def percent_formats(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", tx.human_percent(F.col("l_discount")).alias("discount"))


@star(f"SELECT strftime(make_timestamp(created * 1000), '%Y-%m-%d') AS bucket, count(*) AS n FROM nodes WHERE tag = 'event' AND created BETWEEN {EVENTS_TO - 14 * 86400000} AND {EVENTS_TO} AND trim(coalesce(name, '')) <> '' GROUP BY 1")
def timeline_range(c):
    """The last two weeks, asked for with the ends swapped and beyond the present."""
    first, last, _ = dates.resolve_range(EVENTS_TO + dates.period_ms("6h"), EVENTS_TO - dates.period_ms("2w"), EVENTS_TO)
    return ag.timeline(c, q.find(c, "event"), "day", first, last)


@table("SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN contains(substr(text, 1, 301), ' ') THEN regexp_extract(substr(text, 1, 301), '^(.*) ', 1, 's') ELSE substr(text, 1, 300) END) AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, '  ') AND NOT starts_with(text, ' ')")
def cut_texts(t):
    rows = t("documents").filter("text IS NOT NULL AND NOT contains(text, '  ') AND NOT startswith(text, ' ')")
    return rows.select("doc_id", F.md5(tx.cut_segments(F.col("text"), 300).cast("binary")).alias("digest"))


@table("SELECT event_id, (props::json ->> '$.k')::bigint AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.none') AS has_none FROM events")
def json_paths(t):
    """Paths of JSON: as a number where they are one, and whether they are there."""
    v = F.parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.none").isNotNull().alias("has_none"))


@table("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages")
def decoded(t):
    return t("pages").select("page_id", F.md5(tx.decode_entities(F.col("html")).cast("binary")).alias("digest"))


# Trash and activity

_OWNED = "SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS parent_id, CASE WHEN c_custkey % 9 = 0 THEN 'x_TRASH' WHEN c_custkey % 10 = 0 THEN 'TRASHED' END AS owner FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'customer:' || o_custkey FROM orders"


def _owned(t):
    key = F.col("c_custkey")
    customers = t("customer").select(_at("customer", "c_custkey").alias("id"), _at("nation", "c_nationkey").alias("parent_id"), F.when(key % 9 == 0, "x_TRASH").when(key % 10 == 0, "TRASHED").alias("owner"))
    return customers.unionByName(t("orders").select(_at("order", "o_orderkey").alias("id"), _at("customer", "o_custkey").alias("parent_id"), _at("customer", "o_custkey").alias("owner")))


@table("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 0 UNION ALL SELECT 'order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 0")
def trash_owners(t):
    return gr.owner_in_trash(_owned(t).select("id", "owner"))


@table("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 9 = 0")
def trash_below(t):
    return gr.below_trash(_owned(t))


@table("SELECT c_custkey AS id, floor((996710400000 - greatest(700000000000, coalesce(seen, 0))) / 86400000)::bigint AS age_days, floor((996710400000 - greatest(700000000000, coalesce(seen, 0))) / 86400000) > 200 AS stale FROM customer LEFT JOIN (SELECT o_custkey, max(epoch_us(o_orderdate) // 1000) AS seen FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def freshness_linked(t):
    """Customers count as active when one of their orders was."""
    items = t("customer").select(F.col("c_custkey").alias("id"), F.lit(700000000000).alias("at"))
    links = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("target"))
    return inc.linked_freshness(items, links, t("orders").select(F.col("o_orderkey").alias("target"), millis("o_orderdate").alias("at")), 996710400000, 200)


@export("SELECT tag, coalesce(n, 0) AS uses FROM tags LEFT JOIN (SELECT n_name AS tag, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) USING (tag)")
def live_tags(docs, cat, d):
    """Declared tags that are not in the trash, with their uses."""
    return d.tags.join(ag.tag_counts(cat), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("uses"))


# Attachments


def _page_export(t) -> DataFrame:
    """Pages as nodes of an export that name their address; every third is tagged."""
    key = F.col("page_id")
    of = [
        _node(_at("p", "page_id"), F.concat(F.lit("see "), "url", F.when(key % 4 == 0, "/file.PDF").otherwise("/x.png")), None, None, None), _node(_at("pm", "page_id"), None, _at("p", "page_id"), "metanode", F.array(_at("pt", "page_id"))),
        _node(_at("pt", "page_id"), None, _at("pm", "page_id"), "tuple", F.when(key % 3 == 0, F.array(F.lit(ex.TAG_MARK), F.lit("T"))).otherwise(F.array(F.lit("none")))),
    ]
    pages = t("pages").filter(F.col("url").rlike(r"^https?://[A-Za-z0-9./_-]*[A-Za-z0-9]$")).select("page_id", "url")
    return pages.select(F.inline(F.array(*of))).unionByName(pages.sparkSession.range(1).select(F.inline(F.array(_node(F.lit("T"), F.lit("paper"), None, "tagDef")))))


_PAGES = "SELECT page_id FROM pages WHERE regexp_full_match(url, 'https?://[A-Za-z0-9./_-]*[A-Za-z0-9]')"


@table(f"SELECT CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'png' END AS extension, count(*) AS n FROM ({_PAGES}) GROUP BY 1")
def attachment_extensions(t):
    return at.by(at.scan_export(materialize(_page_export(t))), F.col("extension"), "extension")


@table(f"SELECT 'paper' AS tag, count(*) AS n FROM ({_PAGES}) WHERE page_id % 3 = 0 AND page_id % 4 = 0 HAVING count(*) > 0")
def attachment_tags(t):
    return at.by_tag(at.scan_export(materialize(_page_export(t)), extensions=["PDF"]))


# Sinks and small sources


@table("""WITH n AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation), first AS (SELECT min(id) AS id FROM n)
SELECT 'tsv' AS kind, concat_ws(chr(9), id, name, region) AS line FROM n UNION ALL SELECT 'tsv', concat_ws(chr(9), 'id', 'name', 'region') UNION ALL SELECT 'csv', concat_ws(',', id, name, region) FROM n UNION ALL SELECT 'csv', 'id,name,region' UNION ALL SELECT 'jsonl', to_json({'id': id, 'name': name, 'region': region})::varchar FROM n
UNION ALL SELECT 'ids', id::varchar FROM n UNION ALL SELECT 'minimal', to_json({'id': id, 'name': name})::varchar FROM n UNION ALL SELECT 'json', CASE WHEN n.id <> first.id THEN ',' ELSE '' END || to_json({'id': n.id, 'name': name, 'region': region})::varchar FROM n, first UNION ALL SELECT 'json', unnest(['[', ']'])""")
def sinks(t):
    """The lines that each sink writes."""
    rows = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).coalesce(1).sortWithinPartitions("id")
    spark, out = rows.sparkSession, None
    for kind in fm.FORMATS:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        fm.write(rows, path, kind)
        lines = spark.read.text(path).select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


@star(f"{_USES} SELECT to_json({{'nodes': (SELECT list({{'id': tag, 'fields': fields, 'uses': uses}} ORDER BY tag) FROM uses), 'links': (SELECT list({{'source': child, 'target': parent}} ORDER BY child, parent) FROM tag_parents)}})::varchar AS line")
def hierarchy_json(c):
    return fm.graph_json(c)


@star("SELECT 0 AS part, 'graph BT' AS line UNION ALL SELECT 1, '  ' || child || ' --> ' || parent FROM tag_parents")
def hierarchy_mermaid(c):
    return fm.mermaid(c).select(F.when(F.col("line") == "graph BT", 0).otherwise(1).alias("part"), "line")


@star("SELECT 'digraph tags {' AS line UNION ALL SELECT '  \"' || child || '\" -> \"' || parent || '\";' FROM tag_parents UNION ALL SELECT '}'")
def hierarchy_dot(c):
    return fm.dot(c)


@table("SELECT 'patterns' AS category, doc_id::varchar AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 UNION ALL SELECT 'insights', doc_id::varchar FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def confirmed_learnings(t):
    """Confirmed items of seed files that are written from the documents and read again."""
    docs = t("documents").select("doc_id")
    spark, key = docs.sparkSession, F.col("doc_id")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    item = F.struct(key.cast("string").alias("id"), F.lit("x").alias("content"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("extractedAt"), F.when(key % 3 == 0, "2025-01-02T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("confirmedAt"), (key % 5 >= 0).alias("confirmed"), F.array().cast("array<string>").alias("tags"))
    some = lambda test: F.when(test, F.array(item)).otherwise(F.slice(F.array(item), 1, 0))
    docs.select(F.struct(some(key % 2 == 0).alias("patterns"), some(key % 2 == 1).alias("insights")).alias("learned")).write.json(path)
    seeds = ex.read_seed_lines(spark, path)
    return ex.confirmed(seeds, "2024-06-01").select("category", "id")


@table("SELECT 'w@2025-02-01.json' AS file, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0")
def newest_export(t):
    """Nodes of the newest of two exports, by the date in its name."""
    nation = t("nation")
    spark = nation.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for k, day in enumerate(("2025-02-01", "2025-01-01")):
        docs = nation.filter(F.col("n_nationkey") % 2 == k).select(_node(_at("N", "n_nationkey"), F.col("n_name")).alias("d"))
        docs.agg(F.collect_list("d").alias("docs")).coalesce(1).write.json(f"{folder}/w@{day}.json")  # 25 nations
    newest = ex.latest_export(spark, folder)
    return ex.read_docs(spark, f"{folder}/{newest}").agg(F.count("*").alias("n")).select(F.lit(newest).alias("file"), "n")


@table("SELECT source, id, before FROM (SELECT source, doc_id::varchar AS id, coalesce(sum(ceil(length(text) / 4)::bigint) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id::varchar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM documents) WHERE before < 3000")
def context_overshoot(t):
    items = t("documents").select("source", F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("score"), tx.tokens(F.col("text")).alias("tokens"))
    return se.running_budget(items, 3000, "source").select("source", "id", "before")


@star("SELECT (SELECT count(*) FROM nodes WHERE tag = 'nation') > 20 AS more_than_20, (SELECT count(*) FROM nodes WHERE tag = 'nation') > 25 AS more_than_25")
def pages_beyond(c):
    rows = q.find(c, "nation")
    return rows.sparkSession.createDataFrame([(q.has_more(rows, 20), q.has_more(rows, 20, 5))], "more_than_20 boolean, more_than_25 boolean")


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a feed of orders writes as lines: first creations, then changes of status."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey % 10 = 3")
    node = lambda at_, status: orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("order").alias("name"), F.lit(at_).cast("long").alias("updated"), F.array(status).alias("tags"))
    schema = "id string, name string, updated long, tags array<string>"
    for n, rows in enumerate((node(1, F.col("o_orderstatus")), node(2, F.lit("F")))):
        rows.coalesce(1).write.mode("append").json(f"{folder}/in")
        feed = feeds.read_changes(spark, f"{folder}/in", schema)
        feeds.sync(feed, f"{folder}/table", schema, "id", ["updated"], f"{folder}/checkpoint", feeds.append_events(f"{folder}/log")).awaitTermination()
    return spark.read.json(f"{folder}/log").groupBy("batch", "type", "removed").agg(F.count("*").alias("n")).select(F.col("batch").cast("int").alias("batch"), "type", "removed", "n")


QUERIES |= {"stream_log": stream_log}
ORACLE_SQL |= {"stream_log": "SELECT 0 AS batch, 'create' AS type, '' AS removed, count(*) AS n FROM orders WHERE o_custkey % 10 = 3 HAVING count(*) > 0 UNION ALL SELECT 1, 'modify', CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, count(*) FROM orders WHERE o_custkey % 10 = 3 GROUP BY 3"}
