"""Queries on filters, projections, text, search and attachments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates
from .functions import text as tx
from .operators import attachments as at
from .operators import graph as gr
from .operators import query as q
from .operators import search as se
from .operators import table as tb
from .plans.predicates import structured
from .queries import _JOINED, _VECTORS, _VIA, _WHOLE, _WORDS, QUERY_VECTOR, EVENTS_FROM, NUMBER, ORDERS_AS_OF, _found, _ids, _pairs, _value, star, table

# Filters and projections


@star(_found("order", _value("Status", "lower(value) = 'o'"), _value("TotalPrice", f"{NUMBER} >= 100000"), "NOT " + _value("Missing", "TRUE"), "created > epoch_us(TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY) // 1000", columns="id"))
def uq_structured(c):
    return q.find(c, "order", structured({"Status": {"eq": "O"}, "TotalPrice": {"gte": 100000}, "Missing": {"exists": False}, "created": ">1000d"}), ORDERS_AS_OF).select("id")


@star(_found("order", "created BETWEEN 883612800000 AND 915148800000", _value("Priority", "contains(lower(value), 'high')"), columns="id, created"))
def created_bounds(c):
    return q.created_between(q.find(c, "order", structured({"Priority": "~high"})), 883612800000, 915148800000).select("id", "created")


@star(f"SELECT id, updated FROM nodes WHERE updated > {EVENTS_FROM + 86400000} AND updated < {EVENTS_FROM + 10 * 86400000}")
def updated_bounds(c):
    return q.updated_between(c.nodes, EVENTS_FROM + 86400000, EVENTS_FROM + 10 * 86400000).select("id", "updated")


@star(f"SELECT n.id, coalesce((SELECT string_agg(field || '=' || value, ';' ORDER BY field) FROM ({_JOINED}) v WHERE v.id = n.id), '') AS fields FROM (SELECT * FROM nodes WHERE tag = 'supplier' ORDER BY name DESC, id LIMIT 30) n")
def uq_auto_hydrate(c):
    rows = q.run(c, "supplier", by="name", limit=30)
    return rows.select("id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@star("SELECT n.id, n.name, s.value AS segment, NULL::varchar AS missing FROM nodes n LEFT JOIN fields s ON s.id = n.id AND s.field = 'Segment' WHERE n.tag = 'customer'")
def select_paths(c):
    rows = q.project_paths(q.hydrate(c, q.find(c, "customer"), ["Segment"], "customer"), ["id", "name", "fields.segment", "fields.none"])
    return rows.select("id", "name", "fields.segment", F.col("fields.none").alias("missing"))


@star(f"SELECT p.id, string_agg(f.value, '|' ORDER BY f.value) AS balances FROM {_pairs(_ids('nation'), _ids('supplier'))} p JOIN fields f ON f.id = p.other AND f.field = 'Balance' GROUP BY p.id")
def gq_dot_projection(c):
    pairs = gr.connect(c, q.find(c, "nation"), q.find(c, "supplier"), between=("nation", "supplier"))
    return gr.connected_values(c, pairs, "Balance", "b").select("id", F.array_join("b", "|").alias("balances"))


@star(f"SELECT id, field, CASE WHEN kind = 'number' THEN ({NUMBER})::bigint::varchar || '.0' ELSE nullif(value, '') END AS value, nullif(value, '') AS raw, CASE WHEN value <> '' THEN kind END AS type FROM fields JOIN tag_fields t USING (field) WHERE t.tag = 'customer' AND id LIKE 'customer:%'")
def result_cells(c):
    kinds = c.tag_fields.filter("tag = 'customer'").select("field", "kind")
    rows = c.fields.filter(F.col("id").startswith("customer:")).join(F.broadcast(kinds), "field")  # a tag's attributes
    return rows.select("id", "field", q.cell(F.col("value"), F.col("kind")).alias("x")).select("id", "field", "x.value", "x.raw", "x.type")


_SYSTEM = "('conv', 'region')"
_KEPT = f"(name IS NOT NULL AND (length(name) >= 15 OR tag = 'nation') AND name NOT LIKE '1970-01-01%' AND NOT (contains(name, '[[') AND contains(name, ']]')) AND tag NOT IN {_SYSTEM})"


@star(f"{_WHOLE} SELECT id FROM whole WHERE {_KEPT}")
def content_candidates(c):
    return se.content_candidates(c.texts, F.col("tag") == "nation", ("conv", "region"), 15).select("id")


@star(f"{_WHOLE} SELECT tag, count(*) AS total, count(*) FILTER (NOT coalesce({_KEPT}, false)) AS dropped, round(100.0 * count(*) FILTER (NOT coalesce({_KEPT}, false)) / count(*), 1) AS percent FROM whole GROUP BY tag ORDER BY total DESC, tag LIMIT 20")
def filter_stats(c):
    rows = c.texts
    kept = F.coalesce(se.worth_a_vector(F.col("name"), F.col("tag"), F.col("tag") == "nation", ("conv", "region"), 15), F.lit(False))
    dropped = F.count_if(~kept)
    return rows.groupBy("tag").agg(F.count("*").alias("total"), dropped.alias("dropped"), F.round(100.0 * dropped / F.count("*"), 1).alias("percent")).orderBy(F.desc("total"), "tag").limit(20)


@star("SELECT bucket, start_ms, end_ms, count(*) AS n FROM (SELECT strftime(make_timestamp(created * 1000), '%Y') || '-Q' || quarter(make_timestamp(created * 1000)) AS bucket, epoch_us(date_trunc('quarter', make_timestamp(created * 1000))) // 1000 AS start_ms, epoch_us(date_trunc('quarter', make_timestamp(created * 1000)) + INTERVAL 3 MONTH) // 1000 AS end_ms FROM nodes WHERE tag = 'order') GROUP BY ALL")
def bucket_ranges(c):
    start, end = dates.bucket_range(F.col("created"), "quarter")
    return c.nodes.filter("tag = 'order'").groupBy(dates.bucket(F.col("created"), "quarter").alias("bucket"), start.alias("start_ms"), end.alias("end_ms")).agg(F.count("*").alias("n"))


# Inline references: orders that mention their customer and date


_SPAN = """'See <span class="x" data-inlineref-node="customer:' || o_custkey || '">{0}</span> on <span data-inlineref-date="{{&quot;dateTimeString&quot;:&quot;' || strftime(o_orderdate, '%Y-%m-%d') || '&quot;}}">that day</span>'"""


def _mentioning(t, shown):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").select("o_orderkey", F.concat(F.lit('See <span class="x" data-inlineref-node="customer:'), F.col("o_custkey").cast("string"), F.lit('">'), shown, F.lit('</span> on <span data-inlineref-date="{&quot;dateTimeString&quot;:&quot;'), date, F.lit('&quot;}">that day</span>')).alias("text"))


@table("SELECT o_orderkey, 'See [[customer:' || o_custkey || ']] on ' || strftime(o_orderdate, '%Y-%m-%d') AS bracketed, 'See ' || o_orderpriority || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS shown, 'See ' || o_orderpriority || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS spoken FROM orders")
def inline_formats(t):
    text = F.col("text")
    return _mentioning(t, F.col("o_orderpriority")).select("o_orderkey", tx.format_inline(text).alias("bracketed"), tx.format_inline(text, display=True).alias("shown"), tx.transcript_text(text).alias("spoken"))


@table("SELECT o_orderkey, 'See ' || coalesce(c_name, '') || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 3")
def inline_resolved(t):
    names = t("customer").filter("c_custkey % 10 <> 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return gr.resolve_inline(_mentioning(t, F.lit("")), names, "o_orderkey", "text")


_UNITS = "CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1024 ** 2 THEN printf('%.1f KB', b / 1024) WHEN b < 1024 ** 3 THEN printf('%.1f MB', b / 1024 ** 2) WHEN b < 1024 ** 4 THEN printf('%.1f GB', b / 1024 ** 3) ELSE printf('%.1f TB', b / 1024 ** 4) END"


@table(f"SELECT event_id, (event_id % 6000) // 60 || ':' || lpad((event_id % 60)::varchar, 2, '0') AS clock, {_UNITS} AS size, format('{{:,}}', event_id * 1237) AS number FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 * event_id + 1 ELSE (event_id + 1) * (1000::bigint ** (event_id % 5))::bigint + 1 END AS b FROM events)")
def formats(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 5 == 0, 2 * F.col("event_id") + 1).otherwise((F.col("event_id") + 1) * F.pow(F.lit(1000.0), F.col("event_id") % 5).cast("long") + 1).alias("b"))
    return e.select("event_id", tx.clock(F.col("event_id") % 6000).alias("clock"), tx.human_bytes(F.col("b")).alias("size"), tx.human_number(F.col("event_id") * 1237).alias("number"))


@star(f"SELECT n.id, 'Customer: ' || n.name || ' (in ' || p.name || ') ' || coalesce((SELECT string_agg(field || ': ' || value, ', ' ORDER BY field) FROM ({_JOINED}) v WHERE v.id = n.id), '') AS text FROM nodes n JOIN nodes p ON p.id = n.parent_id WHERE n.tag = 'customer'")
def context_texts(c):
    rows = q.hydrate(c, q.find(c, "customer"), tag="customer")
    above = c.nodes.filter("tag = 'nation'").select(F.col("id").alias("parent_id"), F.col("name").alias("ancestor"))
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return rows.join(above, "parent_id").select("id", tx.context_text(F.col("name"), F.col("ancestor"), F.lit("customer"), fields).alias("text"))


# Search


@table(rf"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' of the ')")
def fts_phrase(t):
    return se.match_phrase(t("documents"), "of The").select("doc_id")


@star(r"SELECT DISTINCT id, value FROM fields WHERE field = 'Priority' AND list_has_all(regexp_extract_all(lower(value), '[\p{L}\p{N}]+'), ['not', 'specified'])")
def fts_field_in(c):
    return se.match_all(c.fields.filter("field = 'Priority'"), ["not", "specified"], "id", "value").select("id", "value").distinct()


@table(f"WITH h AS (SELECT * FROM conversations WHERE contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' in the ')), o AS (SELECT conv_id, first(text ORDER BY turn, role, text) AS opening FROM conversations GROUP BY conv_id) SELECT h.conv_id, turn, role AS speaker, substr(opening, 1, 40) AS meeting FROM h JOIN o USING (conv_id)")
def transcript_hits(t):
    lines = t("conversations")
    meeting = se.transcripts(lines).select("conv_id", F.substring("opening", 1, 40).alias("meeting"))
    return se.match_phrase(lines, "in the").select("conv_id", "turn", F.col("role").alias("speaker")).join(meeting, "conv_id")


_PEOPLE = ("widget, cold", "cold widget", "smal gadget", "as", "Middle East", "ring")
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s''-]', '', 'g'), '\s+', ' ', 'g'))"
_CANDIDATES = rf"""qs AS (SELECT unnest({list(_PEOPLE)}) AS query), sp AS (SELECT query, list_transform(string_split(query, ','), lambda x: trim(x)) AS p, regexp_split_to_array(trim(query), '\s+') AS w FROM qs),
va AS (SELECT query, query AS v FROM qs UNION SELECT query, p[2] || ' ' || p[1] FROM sp WHERE len(p) = 2 AND p[1] <> '' AND p[2] <> '' UNION SELECT query, w[2] || ', ' || w[1] FROM sp WHERE len(w) = 2 AND NOT contains(query, ',')),
ak AS (SELECT DISTINCT query, {_NORM.format('v')} AS q FROM va WHERE length({_NORM.format('query')}) >= 3), nm AS (SELECT id, name, {_NORM.format('name')} AS n, tag = 'region' AS entity FROM nodes WHERE tag IN ('part', 'region') AND name IS NOT NULL),
pr AS (SELECT DISTINCT query, q, id, name, entity, levenshtein(q, lower(name)) AS d FROM ak, nm WHERE list_bool_or(list_transform(list_filter(string_split(q, ' '), lambda x: length(x) >= 2), lambda x: contains(lower(name), x)))),
cd AS (SELECT query, id, name, 1.0::double AS confidence, 'exact' AS how FROM ak JOIN nm ON q = n UNION ALL SELECT query, id, name, round(least(0.95, greatest(0.0, 1 - d / greatest(length(q), length(name)) + CASE WHEN entity THEN 0.05 ELSE 0 END)), 6), 'fuzzy' FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query, q ORDER BY d, id) <= 20))"""


def _named(c):
    return c.nodes.filter("tag IN ('part', 'region')").select("id", "name", F.array("tag").alias("tags"), (F.col("tag") == "region").alias("entity"))


@star(f", {_CANDIDATES} SELECT query, id, name, confidence, how FROM cd WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY confidence DESC, how DESC, name DESC) = 1")
def resolve_candidates(c):
    asked = c.nodes.sparkSession.createDataFrame([(x,) for x in _PEOPLE], "query string")
    return se.candidates(asked, _named(c), limit=20)


@table(f"SELECT vec_id, floor(CASE WHEN s < 0.5 THEN 0 ELSE least(0.95, (s - 0.5) * 1.9) END * 1000000)::bigint AS millionths FROM (SELECT vec_id, (similarity + 1) / 2 AS s FROM {_VECTORS})")
def semantic_confidence(t):
    """Confidence by the similarity to a vector, moved to 0 to 1."""
    hits = se.nearest(t("embeddings"), QUERY_VECTOR, "vec_id", "embedding", None)
    return hits.select("vec_id", F.floor(se.semantic_confidence((F.col("similarity") + 1) / 2) * 1000000).alias("millionths"))


_KEYED = r"lower(trim(regexp_replace(regexp_replace(text, '^\s*-?\s*', ''), '\[\[|\]\]', '', 'g'))) || '|' || array_to_string(list_sort([lang, source]), ',')"


@table(f"SELECT doc_id, similarity FROM (SELECT d.doc_id, v.similarity, {_KEYED} AS k FROM {_VECTORS} v JOIN documents d ON d.doc_id = v.vec_id WHERE v.similarity >= 0.05 AND trim(text) <> '' AND lang = 'en' AND d.doc_id % 7 <> 0 AND NOT (contains(text, '[[') AND contains(text, ']]')) QUALIFY row_number() OVER (PARTITION BY k ORDER BY similarity DESC, d.doc_id) = 1) ORDER BY similarity DESC, doc_id LIMIT 15")
def semantic_hits(t):
    """Documents by their vectors: least similarity, tag, trash, references and repeated names are dealt with before the cut."""
    hits = se.nearest(t("embeddings"), QUERY_VECTOR, "vec_id", "embedding", None).withColumnRenamed("vec_id", "id")
    nodes = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.array("lang", "source").alias("tags"))
    trash = t("documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    return se.semantic_search(hits, nodes, 15, se.least_score("5"), "en", trash).select(F.col("id").alias("doc_id"), "similarity")


@table("SELECT lang, doc_id, n_chars AS score FROM documents WHERE text IS NOT NULL AND NOT (contains(text, '[[') AND contains(text, ']]')) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) = 1 ORDER BY n_chars DESC, doc_id LIMIT 3")
def enrich_hits(t):
    hits = t("documents").select("doc_id", "lang", F.col("text").alias("name"), F.col("n_chars").alias("score")).filter("name IS NOT NULL")
    return se.enrich_hits(hits, "lang", "score", "doc_id", 3).select("lang", "doc_id", "score")


# Attachments: pages whose address is an attachment


@table(r"""SELECT 'page:' || page_id AS id, regexp_extract(url, 'https?://[^\s"''<>)]+', 0) AS url, url_decode(regexp_extract(url, '[^/:]/([^/?#]*)(?:[?#].*)?$', 1)) AS file, lower(regexp_extract(regexp_extract(url, '[^/:]/([^/?#]*)(?:[?#].*)?$', 1), '\.([A-Za-z0-9]+)$', 1)) AS extension, CASE WHEN page_id % 3 = 0 THEN 'site,third' ELSE 'site' END AS tags FROM pages WHERE regexp_matches(url, 'https?://[^\s"''<>)]+')""")
def attachment_scan(t):
    nodes = t("pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("see "), "url", F.lit(" there")).alias("name"), F.lit("site:0").alias("parent_id"), F.when(F.col("page_id") % 3 == 0, F.array(F.lit("third"))).otherwise(F.array().cast("array<string>")).alias("own"))
    tags = nodes.select("id", F.explode("own").alias("tag")).unionByName(nodes.sparkSession.createDataFrame([("site:0", "site")], "id string, tag string"))
    return at.scan(nodes.select("id", "name", "parent_id"), tags).withColumn("tags", F.array_join("tags", ","))


@table("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages WHERE url LIKE 'http%' GROUP BY 1")
def attachment_stats(t):
    nodes = t("pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    found = at.scan(nodes, nodes.select("id", F.lit("page").alias("tag")))
    return at.by(found, F.regexp_extract("url", "://([^/]*)", 1), "host")


@star("SELECT 0 AS part, '| ' || rpad('name', w1::int, ' ') || ' | ' || rpad('Segment', w2::int, ' ') || ' |' AS line FROM (SELECT greatest(4, max(length(name))) AS w1, greatest(7, max(length(value))) AS w2 FROM nodes JOIN fields USING (id) WHERE tag = 'customer' AND field = 'Segment') UNION ALL SELECT 1, '| ' || rpad(name, w1::int, ' ') || ' | ' || rpad(value, w2::int, ' ') || ' |' FROM nodes JOIN fields USING (id), (SELECT greatest(4, max(length(name))) AS w1, greatest(7, max(length(value))) AS w2 FROM nodes JOIN fields USING (id) WHERE tag = 'customer' AND field = 'Segment') WHERE tag = 'customer' AND field = 'Segment'")
def table_padded(c):
    return tb.padded(tb.export_table(c, "customer", q.find(c, "customer"), only=["Segment"]).select("name", "Segment"))
