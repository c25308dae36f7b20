"""Queries over the star-schema catalog, each beside the same query in SQL for the oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import STAR_SQL, Catalog, millis, star_catalog
from .functions import text as tx
from .operators import aggregate as ag
from .operators import graph as gr
from .operators import incremental as inc
from .operators import query as q
from .operators import schema as sc
from .operators import search as se
from .operators import table as tb
from .plans.predicates import AnyOf, Where
from .storage import materialize, shared_dir
from .streaming import feeds

ORDERS_AS_OF = datetime(2001, 8, 2, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
EVENTS_FROM, EVENTS_TO = 1704067200000, 1706659200000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_catalogs: dict[tuple[str, int, str], Catalog] = {}


def catalog_of(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a folder, planned once per session: its tables do not change under the queries."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _catalogs:
        _catalogs[key] = star_catalog(spark, sf_dir)
    return _catalogs[key]


def star(sql: str, views: bool = True) -> Callable:
    """Registers a query over the catalog and its SQL, which sees the catalog's views, or else the tables only."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        # Of found nodes the update time is left out: only events have one.
        drop = "updated" if f.__name__.startswith(("uq_", "gq_find", "batch", "children")) else "-"
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog_of(spark, sf_dir)).drop(drop)
        ORACLE_SQL[f.__name__] = f"{STAR_SQL}\n{sql}" if views else sql
        return f

    return register


def table(sql: str | None) -> Callable:
    """Registers a query over the tables themselves; it gets a reader of tables by name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


NODE = "id, name, parent_id, created"
NUMBER = r"TRY_CAST(regexp_extract(value, '^\s*([+-]?[0-9]*\.?[0-9]+)', 1) AS DOUBLE)"


def _has(tag: str) -> str:
    return f"id IN (SELECT id FROM tags WHERE tag = '{tag}')"


def _value(field: str, test: str) -> str:
    return f"id IN (SELECT id FROM fields WHERE field = '{field}' AND {test})"


def _found(tag: str, *tests: str, columns: str = NODE) -> str:
    return f"SELECT DISTINCT {columns} FROM nodes WHERE " + " AND ".join([_has(tag), *tests])


# Flat queries


@star(_found("order", _value("Status", "lower(value) = 'f'")))
def uq_tag_eq(c):
    return q.find(c, "order", [Where("Status", "=", "F")])


@star(_found("order", _value("Status", "lower(value) <> 'f'")))
def uq_tag_neq(c):
    return q.find(c, "order", [Where("Status", "!=", "F")])


@star(_found("order", _value("TotalPrice", f"{NUMBER} > 200000")))
def uq_range_numeric(c):
    return q.find(c, "order", [Where("TotalPrice", ">", 200000)])


@star(_found("part", _value("Type", "contains(lower(value), 'a')")))
def uq_contains(c):
    return q.find(c, "part", [Where("Type", "~", "A")])


@star(_found("customer", "contains(lower(name), '1')"))
def uq_contains_name(c):
    return q.find(c, "customer", [Where("name", "~", "1")])


@star(_found("order", _value("Part", "value IS NOT NULL")))
def uq_exists(c):
    return q.find(c, "order", [Where("Part", "exists")])


@star(_found("order", "NOT " + _value("Part", "value IS NOT NULL")))
def uq_not_exists(c):
    return q.find(c, "order", [Where("Part", "exists", negate=True)])


@star(_found("supplier", "NOT " + _value("Segment", "value <> ''")))
def uq_is_empty(c):
    return q.find(c, "supplier", [Where("Segment", "empty")])


@star(_found("order", "NOT " + _value("Status", "lower(value) = 'f'")))
def uq_not(c):
    return q.find(c, "order", [Where("Status", "=", "F", negate=True)])


@star(_found("order", f"({_value('Status', 'lower(value) = $$p$$')} OR {_value('Priority', 'lower(value) = $$1-urgent$$')} OR name = 'Order 1')"))
def uq_or_group(c):
    return q.find(c, "order", [AnyOf((Where("Status", "=", "P"), Where("Priority", "=", "1-URGENT"), Where("name", "=", "Order 1")))])


@star(_found("order", _value("Status", "lower(value) = 'o'"), _value("TotalPrice", f"{NUMBER} >= 100000")))
def uq_two_fields(c):
    return q.find(c, "order", [Where("Status", "=", "O"), Where("TotalPrice", ">=", 100000)])


@star(_found("customer", "parent_id IN (SELECT id FROM nodes WHERE contains(lower(name), 'a'))"))
def uq_parent_name(c):
    return q.find(c, "customer", [Where("parent.name", "~", "a")])


@star(_found("order", "parent_id IN (SELECT id FROM tags WHERE tag = 'customer')"))
def uq_parent_tags(c):
    return q.find(c, "order", [Where("parent.tags", "=", "customer")])


@star(_found("order", "created > epoch_us(TIMESTAMP '2001-08-02' - INTERVAL 400 DAY) // 1000"))
def uq_relative_date(c):
    return q.find(c, "order", [Where("created", ">", "400d")], ORDERS_AS_OF)


@star(f"SELECT DISTINCT {NODE} FROM nodes ORDER BY created DESC, id LIMIT 100")
def uq_find_all(c):
    return q.page(q.order(c, q.find(c, None)))


@star(f"SELECT n.id, n.name, n.parent_id, n.created FROM ({_found('order')}) n JOIN fields f ON f.id = n.id AND f.field = 'TotalPrice' ORDER BY TRY_CAST(f.value AS DOUBLE) DESC, n.id LIMIT 50")
def uq_order_field(c):
    return q.page(q.order(c, q.find(c, "order"), "TotalPrice", numeric=True), 50)


@star(_found("customer") + " ORDER BY name, id LIMIT 20 OFFSET 40")
def uq_offset(c):
    return q.page(q.order(c, q.find(c, "customer"), "name", descending=False), 20, 40)


_JOINED = "SELECT id, field, string_agg(value, ', ' ORDER BY value_order, value) AS value FROM fields GROUP BY id, field"


@star(f"SELECT n.id, coalesce(string_agg(v.field || '=' || v.value, ';' ORDER BY v.field), '') AS fields FROM ({_found('order')}) n LEFT JOIN ({_JOINED}) v USING (id) GROUP BY n.id")
def uq_hydrate(c):
    rows = q.hydrate(c, q.find(c, "order"), tag="order")
    return rows.select("id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@star(f"SELECT n.id, n.name, s.value AS status, b.value AS \"Missing\" FROM ({_found('order')}) n LEFT JOIN ({_JOINED}) s ON s.id = n.id AND s.field = 'Status' LEFT JOIN ({_JOINED}) b ON b.id = n.id AND b.field = 'Missing'")
def uq_select_fields(c):
    return q.project(q.hydrate(c, q.find(c, "order"), ["Status"], "order"), ["id", "name", "status", "Missing"])


@star(f"SELECT p.position, p.id, n.name, n.parent_id, coalesce(n.created, 0) AS created FROM (VALUES (0, 'order:7'), (1, 'nation:3'), (2, 'order:7'), (3, 'none:1')) p(position, id) LEFT JOIN nodes n USING (id)")
def batch_get(c):
    ids = c.nodes.sparkSession.createDataFrame([(0, "order:7"), (1, "nation:3"), (2, "order:7"), (3, "none:1")], "position int, id string")
    return q.batch_get(c, ids).fillna(0, ["created"])


@star(f"SELECT {NODE} FROM nodes WHERE parent_id = 'nation:3' ORDER BY id LIMIT 10 OFFSET 2")
def children_page(c):
    return q.children(c, "nation:3", 10, 2)


@star(_found("party", columns=NODE).replace("tag = 'party'", "tag IN ('party', 'customer', 'supplier')"))
def uq_descendants(c):
    return q.find_family(c, "party")


# Aggregation


@star(f"SELECT count(DISTINCT id) AS n FROM nodes WHERE {_has('order')}")
def agg_count(c):
    return q.find(c, "order").agg(F.count_distinct("id").alias("n"))


def _grouped(tag: str, field: str, more: str = "TRUE") -> str:
    return f"SELECT coalesce(f.value, '(none)') AS g0, count(DISTINCT n.id) AS n FROM nodes n LEFT JOIN fields f ON f.id = n.id AND f.field = '{field}' WHERE n.{_has(tag)} AND {more} GROUP BY 1"


@star(_grouped("order", "Priority"))
def agg_field(c):
    return ag.count_by(c, q.find(c, "order"), ["Priority"])


@star(_grouped("event", "K"))
def agg_field_none(c):
    return ag.count_by(c, q.find(c, "event"), ["K"])


_T = "make_timestamp(created * 1000)"
_KEYS = {
    "hour": f"strftime({_T}, '%Y-%m-%dT%H:00:00')",
    "day": f"strftime({_T}, '%Y-%m-%d')",
    "week": f"strftime({_T}, '%Y-W%W')",
    "week_iso": f"strftime({_T}, '%G-W%V')",
    "month": f"strftime({_T}, '%Y-%m')",
    "quarter": f"strftime({_T}, '%Y') || '-Q' || quarter({_T})",
    "year": f"strftime({_T}, '%Y')",
}


def _by_period(period: str) -> None:
    def f(c):
        return ag.count_by(c, q.find(c, "order"), [period])

    f.__name__ = f"agg_{period}"
    star(f"SELECT {_KEYS[period]} AS g0, count(DISTINCT id) AS n FROM nodes WHERE {_has('order')} GROUP BY 1")(f)


for _period in ("day", "week", "week_iso", "month", "quarter", "year"):
    _by_period(_period)


@star(f"SELECT coalesce(f.value, '(none)') AS g0, {_KEYS['year']} AS g1, count(DISTINCT n.id) AS n FROM nodes n LEFT JOIN fields f ON f.id = n.id AND f.field = 'Status' WHERE n.{_has('order')} GROUP BY 1, 2")
def agg_two_level(c):
    return ag.count_by(c, q.find(c, "order"), ["Status", "year"])


@star(f"SELECT g0, n, floor(n * 100 / (SELECT count(DISTINCT id) FROM nodes WHERE {_has('order')}) + 0.5)::bigint AS percent FROM ({_grouped('order', 'Status')})")
def agg_percent(c):
    return ag.count_by(c, q.find(c, "order"), ["Status"], percent=True)


@star(f"SELECT * FROM ({_grouped('order', 'Part')}) ORDER BY n DESC, g0 LIMIT 10")
def agg_top(c):
    return ag.count_by(c, q.find(c, "order"), ["Part"], top=10)


@star(f"SELECT coalesce(g.value, '(none)') AS g0, count(x) AS n, sum(x) AS total, round(avg(x), 6) AS mean, min(x) AS least, max(x) AS most FROM nodes n LEFT JOIN fields g ON g.id = n.id AND g.field = 'Priority' JOIN (SELECT id, {NUMBER} AS x FROM fields WHERE field = 'TotalPrice') v ON v.id = n.id WHERE n.{_has('order')} GROUP BY 1")
def agg_sum_avg_min_max(c):
    return ag.measures(c, q.find(c, "order"), "Priority", "TotalPrice")


@star(_grouped("order", "Priority", "n." + _value("Status", "lower(value) = 'f'")))
def agg_where(c):
    return ag.count_by(c, q.find(c, "order", [Where("Status", "=", "F")]), ["Priority"])


@star("SELECT tag, count(DISTINCT id) AS n FROM tags GROUP BY tag")
def tag_counts(c):
    return ag.tag_counts(c)


@star("SELECT field, count(*) AS n FROM fields GROUP BY field")
def field_name_counts(c):
    return ag.field_counts(c)


@star("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT tag) FROM tags) AS tags, (SELECT count(*) FROM fields) AS field_rows, (SELECT count(DISTINCT field) FROM fields) AS fields")
def db_stats(c):
    return ag.statistics(c)


# Time


def _timeline(period: str) -> None:
    def f(c):
        return ag.timeline(c, q.find(c, "event"), period, EVENTS_FROM, EVENTS_TO)

    f.__name__ = f"timeline_{period}"
    star(f"SELECT {_KEYS[period]} AS bucket, count(*) AS n FROM nodes WHERE {_has('event')} AND created BETWEEN {EVENTS_FROM} AND {EVENTS_TO} AND trim(coalesce(name, '')) <> '' GROUP BY 1")(f)


for _period in ("hour", "day", "week_iso", "month"):
    _timeline(_period)


@star(f"SELECT id, name, created, {_KEYS['day']} AS bucket, row_number() OVER (PARTITION BY {_KEYS['day']} ORDER BY created DESC, id)::int AS rank FROM nodes WHERE tag = 'event' QUALIFY rank <= 3")
def timeline_topn(c):
    return ag.newest_per_bucket(c.nodes.filter("tag = 'event'"), "day", 3)


@star("SELECT id, name, coalesce(updated, created) AS at FROM nodes ORDER BY 3 DESC, id LIMIT 50")
def recent_items(c):
    return q.recent(c)


@star("SELECT id, name, updated FROM nodes WHERE updated IS NOT NULL ORDER BY updated DESC, id LIMIT 50")
def recently_updated(c):
    return q.recently_updated(c)


# Tables


def _wide(tag: str, fields: dict[str, bool]) -> str:
    """SQL of a table; a true field is a reference."""
    cells = ", ".join(f"max(CASE WHEN v.field = '{f}' THEN nullif(v.value, '') END) AS \"{f}\"" for f in fields)
    refs = ", ".join(f"'{f}'" for f, r in fields.items() if r) or "''"
    shown = f"CASE WHEN f.field IN ({refs}) AND regexp_matches(f.value, '^[A-Za-z0-9_:-]{{5,}}$') THEN coalesce(r.name, '[deleted:' || f.value || ']') ELSE f.value END"
    values = f"SELECT f.id, f.field, string_agg({shown}, ', ' ORDER BY f.value_order, {shown}) AS value FROM fields f LEFT JOIN nodes r ON r.id = f.value GROUP BY f.id, f.field"
    return f"SELECT n.id, n.name, {cells} FROM ({_found(tag)}) n LEFT JOIN ({values}) v ON v.id = n.id GROUP BY n.id, n.name"


_CUSTOMER = {"Segment": False, "Balance": False, "Nation": True}


@star(_wide("customer", _CUSTOMER))
def table_export(c):
    return tb.export_table(c, "customer", q.find(c, "customer"))


@star(f"SELECT * FROM ({_wide('customer', _CUSTOMER)}) WHERE lower(\"Segment\") = 'building'")
def table_where(c):
    return tb.where_value(tb.export_table(c, "customer", q.find(c, "customer")), "Segment", "Building")


@star(f"SELECT * FROM ({_wide('customer', _CUSTOMER)}) ORDER BY \"Nation\", id LIMIT 25 OFFSET 25")
def table_sort_page(c):
    return tb.sort_page(tb.export_table(c, "customer", q.find(c, "customer")), "Nation", limit=25, offset=25)


@star(_wide("order", {"Part": True, "Status": False}))
def table_resolve_refs(c):
    return tb.export_table(c, "order", q.find(c, "order"), only=["part", "status"])


@star(f"SELECT '| ' || concat_ws(' | ', id, coalesce(name, '-'), coalesce(\"Status\", '-')) || ' |' AS line FROM ({_wide('order', {'Status': False})})")
def table_markdown(c):
    return tb.markdown(tb.export_table(c, "order", q.find(c, "order"), only=["Status"]))


# Graph

_EDGES = "(SELECT source, target, kind FROM links UNION SELECT id, value_id, 'field' FROM fields WHERE value_id IS NOT NULL)"


def _start(c, *ids):
    return c.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


@star(f"SELECT 'order:7' AS origin, target AS id, min(kind) AS kind, 'out' AS direction, 1 AS distance, 'order:7 > ' || target AS path FROM {_EDGES} e WHERE source = 'order:7' AND target IN (SELECT id FROM nodes) AND target <> 'order:7' GROUP BY target")
def rel_out(c):
    return gr.traverse(c, _start(c, "order:7"), "out")


@star(f"SELECT 'part:1' AS origin, source AS id, min(kind) AS kind, 'in' AS direction, 1 AS distance, 'part:1 > ' || source AS path FROM {_EDGES} e WHERE target = 'part:1' AND source IN (SELECT id FROM nodes) GROUP BY source")
def rel_in(c):
    return gr.traverse(c, _start(c, "part:1"), "in")


_BOTH = f"""(SELECT source AS src, target AS id FROM {_EDGES} UNION SELECT target, source FROM {_EDGES})"""


@star(f""", b AS (SELECT * FROM {_BOTH} WHERE id IN (SELECT id FROM nodes)), o AS (SELECT DISTINCT id FROM b WHERE src = 'nation:3' AND id <> 'nation:3'),
w AS (SELECT DISTINCT b.id FROM o JOIN b ON b.src = o.id WHERE b.id <> 'nation:3' AND b.id NOT IN (SELECT id FROM o))
SELECT id, 1 AS distance FROM o UNION ALL SELECT id, 2 FROM w""")
def rel_both_depth2(c):
    return gr.traverse(c, _start(c, "nation:3"), "both", depth=2).select("id", "distance")


@star("SELECT 'region:0' AS origin, target AS id, kind, 'out' AS direction, 1 AS distance, 'region:0 > ' || target AS path FROM links WHERE source = 'region:0' AND kind = 'child'")
def rel_types(c):
    return gr.traverse(c, _start(c, "region:0"), "out", ("child",))


@star("SELECT l.source AS id, l.target AS other, n.name, l.kind, 'out' AS direction FROM links l LEFT JOIN nodes n ON n.id = l.target WHERE l.source IN ('order:7', 'nation:3') UNION ALL SELECT l.target, l.source, n.name, l.kind, 'in' FROM links l LEFT JOIN nodes n ON n.id = l.source WHERE l.target IN ('order:7', 'nation:3')")
def ref_graph(c):
    return gr.reference_graph(c, _start(c, "order:7", "nation:3"))


def _pairs(left: str, right: str, edges: str = _BOTH) -> str:
    return f"(SELECT DISTINCT src AS id, id AS other FROM {edges} e WHERE src IN ({left}) AND e.id IN ({right}))"


_ids = lambda tag, *tests: _found(tag, *tests, columns="id")
_VIA = "(SELECT id AS src, value_id AS id FROM fields WHERE field = '{0}' AND value_id IS NOT NULL UNION SELECT value_id, id FROM fields WHERE field = '{0}' AND value_id IS NOT NULL)"


@star(_found("supplier", f"id IN (SELECT id FROM {_pairs(_ids('supplier'), _ids('nation'))})"))
def gq_find(c):
    pairs = gr.connect(c, q.find(c, "supplier"), q.find(c, "nation"), between=("supplier", "nation"))
    return q.find(c, "supplier").join(pairs, "id", "left_semi")


@star(f"SELECT p.id, string_agg(n.name, '|' ORDER BY n.name) AS names FROM {_pairs(_ids('nation'), _ids('supplier'))} p JOIN nodes n ON n.id = p.other GROUP BY p.id")
def gq_connected(c):
    return gr.collect_connected(c, gr.connect(c, q.find(c, "nation"), q.find(c, "supplier"), between=("nation", "supplier")))


@star(f"SELECT id, other FROM {_pairs(_ids('order'), _ids('part'), _VIA.format('Part'))}")
def gq_via(c):
    return gr.connect(c, q.find(c, "order"), q.find(c, "part"), "Part")


@star(f"SELECT DISTINCT a.id, b.other FROM {_pairs(_ids('region'), _ids('nation'))} a JOIN {_pairs(_ids('nation'), _ids('supplier'))} b ON b.id = a.other")
def gq_two_hops(c):
    nations = q.find(c, "nation")
    return gr.chain(gr.connect(c, q.find(c, "region"), nations, between=("region", "nation")), gr.connect(c, nations, q.find(c, "supplier"), between=("nation", "supplier")))


@star(f"SELECT count(DISTINCT other) AS n FROM {_pairs(_ids('nation'), _ids('customer'))}")
def gq_count(c):
    return gr.connect(c, q.find(c, "nation"), q.find(c, "customer"), between=("nation", "customer")).agg(F.count_distinct("other").alias("n"))


@star(f"SELECT count(DISTINCT o.other) AS n, sum(x) AS total, round(avg(x), 6) AS mean FROM (SELECT DISTINCT other FROM {_pairs(_ids('nation'), _ids('customer'))}) o LEFT JOIN (SELECT id, {NUMBER} AS x FROM fields WHERE field = 'Balance') v ON v.id = o.other")
def gq_sum_avg(c):
    return gr.connected_measures(c, gr.connect(c, q.find(c, "nation"), q.find(c, "customer"), between=("nation", "customer")), "Balance")


@star(f"SELECT id, other FROM {_pairs(_ids('customer'), _ids('order', _value('Status', 'lower(value) = $$f$$')))}")
def gq_connected_where(c):
    return gr.connect(c, q.find(c, "customer"), q.find(c, "order", [Where("Status", "=", "F")]), between=("customer", "order"))


@star("SELECT 'order:' || o_orderkey AS id, 'nation:' || c_nationkey AS ancestor, 2 AS depth FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def anc_nearest_tagged(c):
    return gr.nearest_ancestor(c, q.find(c, "order").select("id"), ["nation", "region"])


@table("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
u AS (SELECT *, max(CASE WHEN o_orderpriority = '1-URGENT' THEN r END) OVER (PARTITION BY o_custkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM o)
SELECT u.o_orderkey AS id, o.o_orderkey AS ancestor, (u.r - u.near)::int AS depth FROM u JOIN o ON o.o_custkey = u.o_custkey AND o.r = u.near""")
def anc_chain(t):
    """The last urgent order before each order of a customer, up chains of any length."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = lambda c: F.lag(c).over(before)
    up = t("orders").select(F.col("o_orderkey").alias("id"), last("o_orderkey").alias("parent_id"), (last("o_orderpriority") == "1-URGENT").alias("hit"))
    return gr.climb(up, 1 << 20)


@star("""WITH a AS (SELECT 'nation:3 > ' || id AS path, id FROM (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3)),
b AS (SELECT path || ' > order:' || o_orderkey AS path, 'order:' || o_orderkey AS id FROM a JOIN orders ON a.id = 'customer:' || o_custkey)
SELECT 'nation:3' AS origin, id, distance FROM (SELECT id, 1 AS distance, path FROM a UNION ALL SELECT id, 2, path FROM b) ORDER BY distance, path LIMIT 40""", views=False)
def rel_limited(c):
    """The first 40 nodes below one, nearest first."""
    return gr.traverse(c, _start(c, "nation:3"), "out", ("child",), 2, 40).select("origin", "id", "distance")


_UP = """, up AS (SELECT child AS tag, parent AS ancestor, 1 AS depth FROM tag_parents UNION ALL SELECT up.tag, p.parent, depth + 1 FROM up JOIN tag_parents p ON p.child = up.ancestor WHERE depth < 10),
anc AS (SELECT tag, ancestor, min(depth) AS depth FROM up WHERE tag <> ancestor GROUP BY ALL)"""


@star(f"{_UP} SELECT tag, ancestor, depth FROM anc")
def tag_ancestors(c):
    return sc.ancestors(c)


@star(f"{_UP} SELECT ancestor AS tag, tag AS descendant, depth FROM anc")
def tag_descendants(c):
    return sc.descendants(c)


@star(f"{_UP} SELECT max(depth)::bigint AS max_depth FROM anc")
def tag_max_depth(c):
    return sc.deepest(c)


_ALL_FIELDS = f"""{_UP}, every AS (SELECT tag, field, tag AS origin, 0 AS depth, field_order, kind FROM tag_fields UNION ALL SELECT anc.tag, f.field, f.tag, anc.depth, f.field_order, f.kind FROM anc JOIN tag_fields f ON f.tag = anc.ancestor)"""


@star(f"{_ALL_FIELDS} SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY tag, field ORDER BY depth, field_order, origin) = 1")
def tag_all_fields(c):
    return sc.all_fields(c)


# Schema audits

_USES = """, every AS (SELECT tag FROM tags UNION SELECT child FROM tag_parents UNION SELECT parent FROM tag_parents UNION SELECT tag FROM tag_fields),
uses AS (SELECT e.tag, (SELECT count(*) FROM tag_fields f WHERE f.tag = e.tag) AS fields, (SELECT count(DISTINCT id) FROM tags t WHERE t.tag = e.tag) AS uses, (SELECT count(*) FROM tag_parents p WHERE p.child = e.tag) AS parents, (SELECT count(*) FROM tag_parents p WHERE p.parent = e.tag) AS children FROM every e)"""
_KEY = r"regexp_replace(regexp_replace(lower({0}), '[\s_-]+', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')"
_SAME = f"""{_UP}, rel AS (SELECT tag AS a, ancestor AS b FROM anc UNION SELECT ancestor, tag FROM anc), named AS (SELECT *, {_KEY.format('field')} AS key FROM tag_fields),
pairs AS (SELECT x.tag AS a, y.tag AS b, x.key FROM named x JOIN named y ON x.key = y.key AND x.tag < y.tag WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.a = x.tag AND rel.b = y.tag))"""
_FILL = """, inst AS (SELECT tag, count(DISTINCT id) AS instances FROM tags GROUP BY tag), filled AS (SELECT t.tag, v.field, count(*) AS filled FROM (SELECT DISTINCT id, field FROM fields WHERE value <> '') v JOIN (SELECT DISTINCT * FROM tags) t USING (id) GROUP BY ALL),
rates AS (SELECT f.tag, f.field, coalesce(filled, 0) AS filled, instances, round(100 * coalesce(filled, 0) / instances, 6) AS rate FROM tag_fields f JOIN inst USING (tag) LEFT JOIN filled USING (tag, field))"""


@star(f"{_USES} SELECT tag, fields, uses, parents, children FROM uses")
def tag_graph(c):
    return sc.tag_graph(c)


@star(f"{_USES} SELECT tag FROM uses WHERE uses = 0")
def audit_orphans(c):
    return sc.orphan_tags(c)


@star(f"{_USES} SELECT tag, uses FROM uses WHERE uses BETWEEN 1 AND 29")
def audit_low_usage(c):
    return sc.rarely_used(c, 30)


@star(f"{_SAME} SELECT DISTINCT a, b, key FROM pairs")
def audit_duplicates(c):
    return sc.duplicate_fields(c)


@star(f"SELECT {_KEY.format('field')} AS key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM tag_fields GROUP BY 1 HAVING count(DISTINCT kind) > 1")
def audit_type_mismatch(c):
    return sc.type_mismatches(c)


@star(f"{_FILL} SELECT tag, field, filled, instances, rate FROM rates")
def audit_fill_rate(c):
    return sc.fill_rates(c)


@star(f"{_FILL} SELECT tag, field FROM rates WHERE filled = 0")
def audit_unused(c):
    return sc.unused_fields(c)


@star(f"{_SAME} SELECT a, b, count(DISTINCT key) AS shared FROM pairs GROUP BY a, b HAVING count(DISTINCT key) >= 2")
def audit_missing_inheritance(c):
    return sc.missing_inheritance(c, 2)


_TYPE = r"""CASE WHEN value_id IS NOT NULL THEN 'reference' WHEN value IN ('true', 'false') THEN 'checkbox' WHEN regexp_matches(value, '^\d{4}-\d{2}-\d{2}') OR regexp_matches(value, '^PARENT([+-]\d+)?$') OR contains(value, 'data-inlineref-date') THEN 'date' END"""


@star(f"SELECT field, kind, votes FROM (SELECT field, {_TYPE} AS kind, count(*) AS votes FROM (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY field ORDER BY id, value_order) <= 10) GROUP BY 1, 2) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY votes DESC, kind) = 1")
def value_type_vote(c):
    return sc.value_vote(c)


_NAMED = [*"Due Date|Start time|when|Expiry|Homepage URL|Link|Phone number|Item Count|Number|Amount due|Status|Type|Category|isActive|has children|Is done|issue|Enabled|Completed|hash|Owner".split("|")]


@star(rf"""SELECT field, CASE WHEN regexp_matches(f, 'date|time|scheduled|deadline|expir') OR f = 'when' THEN 'date' WHEN regexp_matches(f, 'url|link') THEN 'url' WHEN contains(f, 'phone') THEN 'text' WHEN regexp_matches(f, 'count|number|amount') THEN 'number'
WHEN regexp_matches(f, 'status|type|category') THEN 'reference' WHEN regexp_matches(f, '^(is|has)($|[a-z\s_-])') OR regexp_matches(f, 'enabled|completed') THEN 'checkbox' ELSE 'text' END AS kind
FROM (SELECT field, lower(field) AS f FROM (SELECT field FROM tag_fields UNION SELECT unnest({_NAMED})))""")
def infer_types(c):
    names = c.tag_fields.select("field").union(c.nodes.sparkSession.createDataFrame([(x,) for x in _NAMED], "field string")).distinct()
    return names.select("field", tx.infer_type_by_name(F.col("field")).alias("kind"))


@star(_found("part", columns=f"id, {_KEY.format('name')} AS key"))
def normalize_names(c):
    return q.find(c, "part").select("id", tx.normalize_name(F.col("name")).alias("key"))


# Text, vectors, resolution

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


@table(f"SELECT doc_id, lang FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'license'])")
def fts_and(t):
    return se.match_all(t("documents"), ["the", "License"], "doc_id").select("doc_id", "lang")


def _bm25_sql(terms: list[str], limit: int = 50) -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{x}'))::double" for x in terms]
    tfs = ", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * {se.K1 + 1} / (tf{i} + {se.K1} * (1 - {se.B} + {se.B} * len / avg_len))" for i in range(len(terms)))
    return f"""WITH r AS (SELECT doc_id, len(w)::double AS len, {tfs} FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
s AS (SELECT count(*)::double AS n, avg(len) AS avg_len, {', '.join(f'sum((tf{i} > 0)::int::double) AS df{i}' for i in range(len(terms)))} FROM r)
SELECT doc_id, round({score}, 6) AS score FROM r, s WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))} ORDER BY score DESC, doc_id LIMIT {limit}"""


@table(_bm25_sql(["from", "this"]))
def fts_bm25(t):
    return se.bm25(t("documents"), ["this", "from"], "doc_id")


@star(r"SELECT DISTINCT f.id, f.field, f.value FROM fields f WHERE list_has_all(regexp_extract_all(lower(value), '[\p{L}\p{N}]+'), ['urgent'])")
def fts_fields(c):
    return se.match_all(c.fields, ["urgent"], "id", "value").select("id", "field", "value").distinct()


@table("SELECT conv_id, count(*) AS lines, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers, first(text ORDER BY turn, role, text) AS opening FROM conversations GROUP BY conv_id")
def transcript_list(t):
    return se.transcripts(t("conversations"))


@table("SELECT conv_id, turn, role, length(text)::int AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::bigint AS so_far FROM conversations")
def transcript_lines(t):
    chars = F.length("text")
    return t("conversations").select("conv_id", "turn", "role", chars.alias("chars"), F.sum(chars).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@table(f"WITH h AS (SELECT * FROM conversations WHERE list_has_all({_WORDS.format('text')}, ['the'])) SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS matches FROM h")
def transcript_search(t):
    return se.transcript_search(t("conversations"), ["the"])


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_SIMILARITY = f"round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * q[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x)) * list_sum(list_transform(q, lambda x: x * x))), 6)"
_VECTORS = f"(SELECT *, {_SIMILARITY} AS similarity FROM (SELECT *, {QUERY_VECTOR}::double[] AS q FROM embeddings))"


@table(f"SELECT vec_id, similarity FROM {_VECTORS} ORDER BY similarity DESC, vec_id LIMIT 10")
def vec_topk(t):
    return se.nearest(t("embeddings"), QUERY_VECTOR, "vec_id", "embedding")


@table(f"SELECT vec_id, similarity FROM {_VECTORS} WHERE similarity >= 0.1")
def vec_min_score(t):
    return se.nearest(t("embeddings"), QUERY_VECTOR, "vec_id", "embedding", None, 0.1)


@table(f"SELECT label, vec_id, similarity FROM {_VECTORS} QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) = 1")
def vec_dedupe(t):
    scored = se.nearest(t("embeddings"), QUERY_VECTOR, "vec_id", "embedding", None).join(t("embeddings").select("vec_id", "label"), "vec_id")
    return se.keep_best(scored, "label", "similarity", "vec_id").select("label", "vec_id", "similarity")


_NQ = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s''-]', '', 'g'), '\s+', ' ', 'g'))"
NAMES = ("  Middle  EAST!", "asia", "unknown")
FUZZY = ("midle east", "small rings", "red wigdet", "zzzz")
_FUZZY = f"""qs AS (SELECT query, {_NQ.format('query')} AS q FROM (VALUES {', '.join(f"('{x}')" for x in FUZZY)}) v(query)), ns AS (SELECT id, name, {_NQ.format('name')} AS n FROM nodes WHERE tag IN ('part', 'region')),
m AS (SELECT query, id, name, round(CASE WHEN q = n THEN 1.0 ELSE least(0.95, greatest(0.0, 1 - levenshtein(q, n) / greatest(length(q), length(n)))) END, 6) AS confidence FROM qs, ns WHERE n <> '' AND list_has_any(list_filter(string_split(q, ' '), lambda x: length(x) >= 2), string_split(n, ' ')))"""


def _text_rows(c, values):
    return c.nodes.sparkSession.createDataFrame([(x,) for x in values], "query string")


@star(f"SELECT query, id FROM (VALUES {', '.join(f'($${x}$$)' for x in NAMES)}) v(query) JOIN nodes ON {_NQ.format('query')} = {_NQ.format('name')} WHERE tag IN ('part', 'region') AND {_NQ.format('name')} <> ''")
def resolve_exact(c):
    return se.exact_matches(_text_rows(c, NAMES), c.nodes.filter("tag IN ('part', 'region')"))


@star(f", {_FUZZY} SELECT query, id, name, confidence FROM m")
def resolve_fuzzy(c):
    return se.fuzzy_matches(_text_rows(c, FUZZY), c.nodes.filter("tag IN ('part', 'region')"))


@star(f", {_FUZZY}, r AS (SELECT *, lead(confidence) OVER w AS next, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY query ORDER BY confidence DESC, id)) SELECT query, CASE WHEN confidence < 0.85 THEN 'no_match' WHEN next IS NULL OR round(confidence - next, 6) >= 0.1 THEN 'matched' ELSE 'ambiguous' END AS action, id, confidence FROM r WHERE r = 1")
def resolve_action(c):
    return se.resolve(se.fuzzy_matches(_text_rows(c, FUZZY), c.nodes.filter("tag IN ('part', 'region')")))


@table("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def strip_html(t):
    return t("pages").select("page_id", F.md5(tx.strip_html(F.col("html")).cast("binary")).alias("digest"))


_PHRASE = r"list_filter(list_transform(regexp_extract_all(text, '(?:^|\s)((?:[A-Z][a-zA-Z-]+(?:\s+|$)){2,4})', 1, 'm'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4 AND regexp_extract(x, '^\S+') NOT IN ('The', 'This', 'That', 'These', 'Those', 'When', 'Where', 'Which', 'While', 'What', 'Should', 'Could', 'Would', 'About', 'Always', 'Never', 'Often', 'Sometimes'))"
_QUOTED = r"""list_transform(regexp_extract_all(text, '["'']([A-Z][^"'']{2,50})["'']', 1), lambda x: trim(x))"""


@table(f"""SELECT doc_id, array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), '|') AS mentions
FROM (SELECT doc_id, list_concat({_QUOTED}, {_PHRASE}, regexp_extract_all(text, '@([a-zA-Z][a-zA-Z0-9_-]{{1,30}})', 1), regexp_extract_all(text, '#([a-zA-Z][a-zA-Z0-9_-]{{2,30}})', 1)) AS l FROM documents)""")
def mentions(t):
    return t("documents").select("doc_id", F.array_join(tx.mentions(F.col("text")), "|").alias("mentions"))


@table(r"SELECT page_id, regexp_extract(url, '[^/]/([^/?#]*)(?:[?#].*)?$', 1) AS file, regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1) AS extension FROM pages")
def attachments(t):
    return t("pages").select("page_id", F.regexp_extract("url", "[^/]/([^/?#]*)(?:[?#].*)?$", 1).alias("file"), F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1).alias("extension"))


# Content filters, context, incremental


#: Nodes with their whole texts: documents are named by their beginning only.
_WHOLE = ", whole AS (SELECT id, name, tag FROM nodes WHERE tag <> 'document' UNION ALL SELECT 'document:' || doc_id, text, 'document' FROM documents)"


@star(f"{_WHOLE} SELECT tag, count(*) AS n, count(*) FILTER (name IS NOT NULL AND length(name) >= 15 AND NOT (contains(name, '[[') AND contains(name, ']]')) AND name NOT LIKE '1970-01-01%') AS kept FROM whole GROUP BY tag")
def content_filter(c):
    name = F.col("name")
    kept = name.isNotNull() & (F.length(name) >= 15) & ~(name.contains("[[") & name.contains("]]")) & ~name.startswith("1970-01-01")
    return c.texts.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"))


@star("SELECT count(*) AS total, count(*) FILTER (id IN (SELECT id FROM tags WHERE tag LIKE '%\\_%' ESCAPE '\\')) AS tagged, count(*) FILTER (parent_id IS NULL) AS roots FROM nodes")
def entity_stats(c):
    second = c.tags.filter(F.col("tag").contains("_")).select("id").distinct().withColumn("second", F.lit(True))
    return c.nodes.join(second, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("second")).alias("tagged"), F.count_if(F.col("parent_id").isNull()).alias("roots"))


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_NEW_ORDERS = f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 = 0"


def _two_versions(t):
    old = t("orders").select(*_ORDER.split(", "))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    new = old.filter(key % 5 != 0).withColumn("o_orderstatus", F.when(key % 7 == 0, "X").otherwise(status))
    return old, new.unionByName(old.filter(key % 11 == 0).withColumn("o_orderkey", key + 1000000000))


@table(f"WITH new AS ({_NEW_ORDERS}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM orders o FULL JOIN new n ON n.o_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus")
def checksum_diff(t):
    return inc.checksum_diff(*_two_versions(t), "o_orderkey", _ORDER.split(", "))


@table(f"WITH new AS ({_NEW_ORDERS}) SELECT CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'modify' END AS type, coalesce(o.o_orderkey, n.o_orderkey) AS id, coalesce(n.o_custkey, o.o_custkey)::varchar AS name, o.o_custkey::varchar AS name_before, CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN coalesce(n.o_orderstatus, '') ELSE '' END AS added, CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN coalesce(o.o_orderstatus, '') ELSE '' END AS removed FROM orders o FULL JOIN new n ON n.o_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus")
def snapshot_diff(t):
    shape = lambda df: df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("name"), F.lit(0).alias("updated"), F.array("o_orderstatus").alias("tags"))
    return inc.snapshot_diff(*map(shape, _two_versions(t)))


@table("WITH last AS (SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1) SELECT c_custkey AS user_id, 0::bigint AS event_id, NULL::timestamp AS ts, c_mktsegment AS event_type FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT * FROM last")
def delta_upsert(t):
    target = t("customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("c_mktsegment").alias("event_type"))
    return inc.upsert(target, t("events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@table("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def stale_ids(t):
    return inc.stale(t("customer").select("c_custkey"), t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@table(f"SELECT event_id AS id, floor(({EVENTS_TO} - epoch_us(ts) // 1000) / 86400000)::bigint AS age_days, floor(({EVENTS_TO} - epoch_us(ts) // 1000) / 86400000) > 14 AS stale FROM events")
def freshness(t):
    return inc.freshness(t("events").select(F.col("event_id").alias("id"), millis("ts").alias("at")), EVENTS_TO, 14)


@star("""SELECT id, round(0.6 / 2 + 0.4 * exp(-((996710400000 - 1704067200000) / 86400000) / 30), 6) AS score FROM (SELECT 'customer:' || o_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7
UNION SELECT 'part:' || l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7)""", views=False)
def context_scored(c):
    near = materialize(gr.traverse(c, _start(c, "order:7"), "both").select("id", "distance"))
    near = near.join(c.of(c.nodes, c.kinds_of(near), "tag").select("id", "created"), "id")
    age = (F.lit(996710400000) - F.col("created")) / 86400000
    return near.select("id", F.round(se.relevance(F.col("distance"), F.lit(None).cast("double"), age), 6).alias("score"))


@star(f"SELECT n.id, concat_ws(' ', '[Type: #part]', '[Brand: ' || b.value || ']', '[Size: ' || s.value || ']', n.name) AS text FROM ({_found('part')}) n LEFT JOIN fields b ON b.id = n.id AND b.field = 'Brand' LEFT JOIN fields s ON s.id = n.id AND s.field = 'Size'")
def enriched_text(c):
    rows = q.hydrate(c, q.find(c, "part"), ["Brand", "Size"], "part")
    entries = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    return rows.select("id", tx.enriched(F.array(F.lit("part")), entries, F.col("name")).alias("text"))


_MIXED = "(('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 1000) / 1000"


@table(f"""WITH RECURSIVE s AS (SELECT source, doc_id::varchar AS id, {_MIXED} AS score, ceil(length(text) / 4)::bigint AS tokens FROM documents),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r FROM s WHERE tokens <= 4000),
g AS (SELECT source, r, id, true AS fits, tokens AS used FROM k WHERE r = 1
UNION ALL SELECT k.source, k.r, k.id, g.used + k.tokens <= 4000, g.used + CASE WHEN g.used + k.tokens <= 4000 THEN k.tokens ELSE 0 END FROM g JOIN k ON k.source = g.source AND k.r = g.r + 1)
SELECT source, max(used) OVER (PARTITION BY source) AS used, (row_number() OVER (PARTITION BY source ORDER BY r) - 1)::int AS position, id FROM g WHERE fits""")
def context_budget(t):
    score = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1000 / 1000
    items = t("documents").select("source", F.col("doc_id").cast("string").alias("id"), score.alias("score"), tx.tokens(F.col("text")).alias("tokens"))
    return se.within_budget(items, 4000, "source")


# Streams: the events table read as a feed, to its end


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _batches(spark: SparkSession, sf_dir: str, folder: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events as a feed of four batches, dealt out regardless of their times; the files of a batch grow in number, not in size."""
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = rows(spark.read.parquet(f"{sf_dir}/events.parquet")).repartition(4 * files, F.xxhash64("event_id"))
    dealt.write.parquet(f"{folder}/feed")
    return spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted by a stream."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    events = _feed(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = feeds.windowed_counts(events, "ts", "event_type")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, by a stream whose batches are out of order; users whose latest event is an error are deleted."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = "user_id long, event_id long, ts timestamp, event_type string"
    changes = _batches(spark, sf_dir, folder, lambda e: e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("event_type") == "error").alias("gone")))
    feeds.sync(changes, f"{folder}/table", schema, "user_id", ["ts", "event_id"], f"{folder}/checkpoint", deleted="gone").awaitTermination()
    return feeds.read_current(spark, f"{folder}/table", schema).select("user_id", "event_id", F.unix_millis("ts").alias("ts_ms"), "event_type")


def stream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as nodes whose latest event gives name, tag and attributes, by a feed of batches out of order."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    value = lambda name, c: F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    node = lambda e: e.select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("name"), none.alias("parent_id"), F.lit(0).cast("long").alias("created"), (F.unix_millis(F.col("ts").cast("timestamp")) * 1000000 + F.col("event_id")).alias("updated"), F.array(F.lit("user"), "event_type").alias("tags"), F.array(value("Value", F.floor("value")), value("Event", F.col("event_id"))).alias("fields"), (F.col("event_type") == "error").alias("deleted"))
    feeds.sync_nodes(_batches(spark, sf_dir, folder, node), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    store = feeds.node_store(spark, f"{folder}/table")
    values = store.read("fields").groupBy("id").pivot("field", ["Value", "Event"]).agg(F.first("value"))
    return feeds.snapshot(spark, f"{folder}/table").join(values, "id").select("id", "name", F.array_join("tags", ",").alias("tags"), F.col("Value").alias("value"), F.col("Event").alias("event"))


_LAST_EVENT = "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

QUERIES |= {"stream_events": stream_events, "stream_delta": stream_delta, "stream_nodes": stream_nodes}
ORACLE_SQL |= {
    "stream_events": "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_delta": f"SELECT user_id, event_id, ts_ms, event_type FROM ({_LAST_EVENT}) WHERE event_type <> 'error'",
    "stream_nodes": f"SELECT 'user:' || user_id AS id, event_type AS name, CASE WHEN event_type < 'user' THEN event_type || ',user' ELSE 'user,' || event_type END AS tags, floor(value)::bigint::varchar AS value, event_id::varchar AS event FROM ({_LAST_EVENT}) WHERE event_type <> 'error'",
}
