"""Queries on the tag hierarchy, contents of nodes, entities and contexts, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import contents as co
from .operators import entities as en
from .operators import graph as gr
from .operators import query as q
from .operators import schema as sc
from .queries import _FILL, _KEY, _SAME, _UP, _USES, EVENTS_TO, _start, star, table
from .sources import formats
from .storage import shared_dir


@star(f"{_UP}, e AS (SELECT DISTINCT child, parent FROM tag_parents), w AS (SELECT child AS tag, parent AS top, child || ' > ' || parent AS path FROM e UNION ALL SELECT w.tag, e.parent, w.path || ' > ' || e.parent FROM w JOIN e ON e.child = w.top) SELECT tag, path FROM w WHERE top NOT IN (SELECT child FROM e)")
def inheritance_paths(c):
    return sc.paths_up(c)


@star(f"{_UP}, d AS (SELECT 'order' AS tag UNION SELECT tag FROM anc WHERE ancestor = 'order') SELECT tag FROM d UNION SELECT parent FROM tag_parents WHERE child IN (SELECT tag FROM d)")
def tag_family(c):
    return sc.family(c, "order")


@star(f"{_UP}, d AS (SELECT 'record' AS tag, 0 AS depth UNION ALL SELECT tag, depth FROM anc WHERE ancestor = 'record') SELECT tag, depth, coalesce((SELECT string_agg(field, ',' ORDER BY field_order, field) FROM tag_fields f WHERE f.tag = d.tag), '') AS fields FROM d")
def subtree(c):
    return sc.below(c, "record")


@star(f"{_USES}, e AS (SELECT DISTINCT child, parent FROM tag_parents), w AS (SELECT tag, 0 AS level FROM every WHERE tag NOT IN (SELECT child FROM e) UNION SELECT e.child, level + 1 FROM w JOIN e ON e.parent = w.tag), m AS (SELECT tag, max(level) AS level FROM w GROUP BY tag) SELECT (row_number() OVER (ORDER BY level, tag) - 1)::int AS position, tag, level FROM m")
def tag_order(c):
    return sc.topological(c)


@star("SELECT field, tag, kind FROM tag_fields WHERE tag IN ('supplier', 'event', 'order', 'party') QUALIFY row_number() OVER (PARTITION BY field ORDER BY CASE tag WHEN 'supplier' THEN 1 WHEN 'event' THEN 2 WHEN 'order' THEN 3 ELSE 4 END, field_order) = 1")
def merged_fields(c):
    return sc.merged_fields(c, ["supplier", "event", "order", "party"])


@star(f"{_USES} SELECT split_part(tag, '_', 1) AS name, tag FROM uses QUALIFY row_number() OVER (PARTITION BY split_part(tag, '_', 1) ORDER BY parents DESC, fields DESC, tag) = 1")
def tag_lookup(c):
    return sc.lookup(c, sc.tag_graph(c).select("tag", F.substring_index("tag", "_", 1).alias("name")))


@star(f"{_USES} SELECT tag FROM every WHERE contains(lower(tag), 'orderf') OR contains({_KEY.format('tag')}, 'orderf')")
def tag_search(c):
    return sc.search_tags(c, "OrderF")


@star(f"""{_UP}, al AS (SELECT tag, field, tag AS origin, 0 AS depth, field_order FROM tag_fields UNION ALL SELECT anc.tag, f.field, f.tag, anc.depth, f.field_order FROM anc JOIN tag_fields f ON f.tag = anc.ancestor),
best AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY tag, field ORDER BY depth, field_order, origin) = 1)
SELECT p.tag, p.field, b.origin IS NOT NULL AS valid, b.origin FROM (SELECT t.tag, f.field FROM (SELECT DISTINCT tag FROM tag_fields) t, (SELECT DISTINCT field FROM tag_fields) f) p LEFT JOIN best b USING (tag, field)""")
def field_check(c):
    pairs = c.tag_fields.select("tag").distinct().crossJoin(c.tag_fields.select("field").distinct())  # a schema's worth of rows
    return sc.check_fields(c, pairs)


_ASKED = [("ASIA", "Nation", "region"), ("asia ", "Nation", "region"), ("1-URGENT", "Priority", "none"), ("1_urgent", "Priority", "none"), ("Customer#000000007", "Nation", "nation"), ("customer 000000007", "Nation", "nation"), ("nobody", "Nation", "nation")]


@star(f""", a AS (SELECT *, {_KEY.format('query')} AS key FROM (VALUES {', '.join(str(x) for x in _ASKED)}) v(query, field, target)), n AS (SELECT id, tag, name, {_KEY.format('name')} AS key FROM nodes WHERE name IS NOT NULL),
h AS (SELECT query, id, CASE WHEN tag = target THEN CASE WHEN query = name THEN 1 ELSE 2 END WHEN query = name THEN 5 ELSE 6 END AS rule FROM a JOIN n USING (key) WHERE key <> ''
UNION ALL SELECT query, value, CASE WHEN query = value THEN 3 ELSE 4 END FROM a JOIN (SELECT DISTINCT field, value, {_KEY.format('value')} AS key FROM fields WHERE field IN ('Nation', 'Priority')) USING (field, key))
SELECT query, id, rule FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY rule, id) = 1""")
def resolve_values(c):
    return sc.resolve_values(c, c.nodes.sparkSession.createDataFrame(_ASKED, "query string, field string, target string"))


@star(f"""{_USES}{_SAME}{_FILL}, found AS (SELECT 'info' AS s FROM uses WHERE uses = 0 UNION ALL SELECT 'info' FROM uses WHERE uses BETWEEN 1 AND 2 UNION ALL SELECT 'warning' FROM (SELECT DISTINCT a, b, key FROM pairs)
UNION ALL SELECT 'error' FROM (SELECT {_KEY.format('field')} AS key FROM tag_fields GROUP BY 1 HAVING count(DISTINCT kind) > 1) UNION ALL SELECT 'info' FROM rates WHERE filled = 0 UNION ALL SELECT 'warning' FROM rates WHERE filled > 0 AND rate < 10
UNION ALL SELECT 'warning' FROM (SELECT a, b FROM pairs GROUP BY a, b HAVING count(DISTINCT key) >= 3))
SELECT count(*) AS findings, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'info') AS info FROM found""")
def audit_severities(c):
    return sc.severities(sc.audit(c))


@star(f"{_USES} SELECT tag, uses = 0 AS orphan, children = 0 AS leaf FROM uses")
def tag_flags(c):
    return sc.tag_graph(c).select("tag", (F.col("uses") == 0).alias("orphan"), (F.col("children") == 0).alias("leaf"))


@star("SELECT field, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tag_fields GROUP BY field")
def field_tags(c):
    return c.tag_fields.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@star(f"{_USES} SELECT tag, uses, row_number() OVER (ORDER BY uses DESC, tag)::int AS rank FROM uses")
def list_tags(c):
    return co.ranked(sc.tag_graph(c).select("tag", "uses"), "uses", "tag")


@star(f"{_USES} SELECT tag, uses, fields FROM uses WHERE NOT contains(tag, 'error')")
def tags_with_metadata(c):
    return sc.tag_graph(c).filter(~F.col("tag").contains("error")).select("tag", "uses", "fields")


@star("SELECT tag, field FROM tag_fields f WHERE NOT EXISTS (SELECT 1 FROM fields v WHERE v.field = f.field)")
def unmapped_fields(c):
    return c.tag_fields.select("tag", "field").join(c.fields.select("field").distinct(), "field", "left_anti").select("tag", "field")


@star("SELECT count(*) AS n FROM fields WHERE field = 'Priority'")
def field_count(c):
    return c.fields.filter(F.col("field") == "Priority").agg(F.count("*").alias("n"))


@star("SELECT tag, to_json({'tag': tag, 'fields': list({'field': field, 'kind': kind} ORDER BY field_order, field)})::varchar AS line FROM tag_fields GROUP BY tag")
def schema_cache(c):
    """The cache as it is written and read again."""
    path = f"{shared_dir(c.tag_fields.sparkSession)}/{uuid.uuid4().hex}"
    formats.save_schema(c, path)
    line = c.tag_fields.sparkSession.read.text(path).withColumnRenamed("value", "line")
    return line.select(F.get_json_object("line", "$.tag").alias("tag"), "line")


# Contents


_MEANT = r"(regexp_matches(value, '^\d{4}-\d{2}-\d{2}') OR starts_with(value, '[[') OR NOT regexp_matches(value, '^[a-zA-Z0-9_-]{12,}$'))"


@star(f"""SELECT n.id, n.name, coalesce((SELECT string_agg(field || '=' || value, ';' ORDER BY field) FROM (SELECT field, string_agg(value, ', ' ORDER BY value_order, value) AS value FROM fields f WHERE f.id = n.id AND {_MEANT} GROUP BY field)), '') AS fields,
(SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tags t WHERE t.id = n.id) AS tags, coalesce((SELECT string_agg(x.id, ',' ORDER BY x.id) FROM nodes x WHERE x.parent_id = n.id), '') AS children FROM nodes n WHERE n.tag = 'customer'""")
def node_contents(c):
    rows = co.node_contents(c, q.find(c, "customer"), "customer")
    return rows.select("id", "name", F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit("="), x["value"])), ";").alias("fields"), F.array_join("tags", ",").alias("tags"), F.array_join("children", ",").alias("children"))


@star("SELECT id AS root, id, NULL::varchar AS parent_id, 0 AS depth FROM nodes WHERE tag = 'region' UNION ALL SELECT parent_id, id, parent_id, 1 FROM nodes WHERE tag = 'nation' UNION ALL SELECT n.parent_id, x.id, n.id, 2 FROM nodes x JOIN nodes n ON n.id = x.parent_id WHERE n.tag = 'nation'")
def contents_depth(c):
    return co.expand(c, q.find(c, "region"), 2)


@star("SELECT position, v.id, n.name, d.depth, d.at FROM (VALUES (0, 'nation:3'), (1, 'none:1'), (2, 'region:0')) v(position, id) LEFT JOIN nodes n USING (id) LEFT JOIN (SELECT id AS root, id AS at, 0 AS depth FROM nodes WHERE tag IN ('nation', 'region') UNION ALL SELECT parent_id, id, 1 FROM nodes WHERE parent_id IS NOT NULL) d ON d.root = v.id")
def batch_get_depth(c):
    ids = c.nodes.sparkSession.createDataFrame([(0, "nation:3"), (1, "none:1"), (2, "region:0")], "position int, id string")
    known = c.nodes.join(ids, "id", "left_semi").select("id")
    below = co.expand(c, known, 1).select("root", F.col("id").alias("at"), "depth")
    return ids.join(c.nodes.select("id", "name"), "id", "left").join(below, F.col("id") == F.col("root"), "left").select("position", "id", "name", "depth", "at")


@star("SELECT tag, CASE WHEN tag IN ('conv', 'line') THEN 2 ELSE 1 END AS depth, count(*) AS n FROM nodes GROUP BY ALL")
def smart_depth(c):
    return c.nodes.groupBy("tag", co.smart_depth(F.col("tag"), calendar=("conv", "line")).alias("depth")).agg(F.count("*").alias("n"))


# Ancestors and entities


@star("SELECT 'customer:' || c_custkey AS id, r_name || ' > ' || n_name || ' > ' || c_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'supplier:' || s_suppkey, r_name || ' > ' || n_name || ' > ' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey", views=False)
def anc_names(c):
    start = c.nodes.filter("tag IN ('customer', 'supplier')").select("id")
    return gr.name_paths(c, start)


@star("SELECT 'line:' || conv_id || ':' || turn AS id, 'conv:' || conv_id AS ancestor, 1 AS depth FROM conversations UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, 1 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE trim(r_name) <> ''", views=False)
def anc_nearest_named(c):
    return gr.nearest_named(c, c.nodes.filter("tag IN ('line', 'nation')").select("id"))


@star("SELECT c.parent_id AS ancestor, count(*) AS n FROM nodes o JOIN nodes c ON c.id = o.parent_id WHERE o.tag = 'order' GROUP BY 1")
def ancestor_groups(c):
    found = gr.nearest_ancestor(c, q.find(c, "order").select("id"), ["nation"])
    return found.groupBy("ancestor").agg(F.count("*").alias("n"))


@star("""WITH n AS (SELECT n_nationkey AS k FROM nation WHERE contains('nation:' || n_nationkey, 'nation:3')), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n))
SELECT 'nation:' || k AS id FROM n UNION ALL SELECT 'customer:' || k FROM c UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey IN (SELECT k FROM n) UNION ALL SELECT 'order:' || o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM c)""", views=False)
def trash_ancestors(c):
    return gr.in_trash(c, c.nodes.filter("tag IN ('nation', 'customer', 'supplier', 'order')").select("id"), mark="nation:3")


_ENTITY = """, e AS (SELECT id, parent_id, CASE WHEN id LIKE '%7' THEN true WHEN id LIKE '%8' THEN false END AS override, length(name) % 5 AS flags, CASE WHEN id LIKE '%4' THEN 'x_STASH' WHEN id LIKE '%5' THEN 'TRASH' ELSE parent_id END AS owner, tag = 'region' AS tagged FROM nodes WHERE tag IN ('region', 'nation', 'customer', 'order')),
x AS (SELECT *, coalesce(override, flags % 2 = 1 OR coalesce(owner LIKE '%\\_STASH' ESCAPE '\\', false) OR tagged) AS entity FROM e)"""


def _entity_rows(c):
    n = c.nodes.filter("tag IN ('region', 'nation', 'customer', 'order')")
    ends = lambda x: F.col("id").endswith(x)
    rows = n.select("id", "parent_id", F.when(ends("7"), True).when(ends("8"), False).alias("override"), (F.length("name") % 5).alias("flags"), F.when(ends("4"), "x_STASH").when(ends("5"), "TRASH").otherwise(F.col("parent_id")).alias("owner"), (F.col("tag") == "region").alias("tagged"))
    return rows.withColumn("entity", en.is_entity(F.col("override"), F.col("flags"), F.col("owner"), F.col("tagged")))


@star(f"{_ENTITY} SELECT id, entity FROM x")
def entity_flags(c):
    return _entity_rows(c).select("id", "entity")


@star(f"{_ENTITY} SELECT count(*) AS live, count(*) FILTER (override) AS overridden, count(*) FILTER (override IS NULL AND flags % 2 = 1) AS automatic, count(*) FILTER (tagged) AS tagged, count(*) FILTER (entity) AS entities FROM x WHERE NOT coalesce(contains(owner, 'TRASH'), false)")
def entity_counts(c):
    return en.entity_counts(_entity_rows(c))


@star(f"{_ENTITY}, w AS (SELECT id, parent_id AS top, 1 AS depth FROM x WHERE parent_id IS NOT NULL UNION ALL SELECT w.id, x.parent_id, depth + 1 FROM w JOIN x ON x.id = w.top WHERE NOT x.entity AND x.parent_id IS NOT NULL) SELECT w.id, top AS ancestor, depth FROM w JOIN x ON x.id = w.top WHERE x.entity")
def anc_entity(c):
    rows = _entity_rows(c)
    return en.nearest_entity(rows, rows.select("id"))


# Context


_GREEDY = """, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s),
g AS (SELECT r, id, tokens, tokens <= {budget} AS fits, CASE WHEN tokens <= {budget} THEN tokens ELSE 0 END AS used FROM k WHERE r = 1
UNION ALL SELECT k.r, k.id, k.tokens, g.used + k.tokens <= {budget}, g.used + CASE WHEN g.used + k.tokens <= {budget} THEN k.tokens ELSE 0 END FROM g JOIN k ON k.r = g.r + 1)"""


@star(f""", d AS (SELECT DISTINCT id FROM (SELECT target AS id FROM links WHERE source = 'nation:3' UNION ALL SELECT source FROM links WHERE target = 'nation:3' UNION ALL SELECT id FROM fields WHERE value_id = 'nation:3') JOIN (SELECT id FROM nodes) USING (id)),
s AS (SELECT id, 1 AS distance, round(round(0.6 / 2 + 0.4 * exp(-((1706659200000 - created) / 86400000) / 30), 6) + CASE WHEN tag = 'supplier' THEN 0.1 ELSE 0 END, 6) AS score, ceil(length(coalesce(name, '')) / 4)::bigint AS tokens FROM d JOIN nodes USING (id)){_GREEDY.format(budget=60)}
SELECT (row_number() OVER (ORDER BY g.r) - 1)::int AS position, g.id, distance, score, g.tokens FROM g JOIN s USING (id) WHERE fits""")
def context_assembled(c):
    return co.context(c, _start(c, "nation:3"), EVENTS_TO, 60, wanted=("supplier",))


@table("SELECT round(100.0 * count(vec_id) / count(*), 1) AS percent, count(*) AS named, count(vec_id) AS embedded FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id WHERE trim(coalesce(text, '')) <> ''")
def embedding_coverage(t):
    named = t("documents").filter("trim(coalesce(text, '')) <> ''").select("doc_id")
    rows = named.join(t("embeddings").select(F.col("vec_id")).distinct(), F.col("doc_id") == F.col("vec_id"), "left")
    return rows.agg(F.round(100.0 * F.count("vec_id") / F.count("*"), 1).alias("percent"), F.count("*").alias("named"), F.count("vec_id").alias("embedded"))
