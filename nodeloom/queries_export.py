"""Queries on exports made of the tables: declared schemas with inheritance, and transcripts, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import schema as sc
from .queries import _KEY, ORACLE_SQL, QUERIES
from .sources import export_json as ex
from .sources import export_schema as es
from .sources import export_transcripts as et
from .storage import materialize, spread

FIELDS = "id string, props struct<created:bigint,name:string,_ownerId:string,_docType:string,_done:string,_sourceId:string,description:string,_color:string>, children array<string>, modifiedTs string"


def _node(at: Column, name: Column | None = None, owner: Column | None = None, kind: str | None = None, children: Column | None = None, source: str | None = None, description: Column | None = None) -> Column:
    text = lambda c, n: (F.lit(None) if c is None else c).cast("string").alias(n)
    props = F.struct(F.lit(1704067200000).alias("created"), text(name, "name"), text(owner, "_ownerId"), F.lit(kind).cast("string").alias("_docType"), text(None, "_done"), F.lit(source).cast("string").alias("_sourceId"), text(description, "description"), text(None, "_color"))
    return F.struct(at.alias("id"), props.alias("props"), (F.array().cast("array<string>") if children is None else children).alias("children"), F.lit("1704067200001").alias("modifiedTs"))


def _ids(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _at(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _tag(at: Column, meta: Column, tuple_id: Column, name: Column, parents: Column, own: Column, description: Column | None = None) -> list[Column]:
    """A tag with its metanode and the tuple that states its parents."""
    return [_node(at, name, None, "tagDef", own, description=description), _node(meta, None, at, "metanode", F.array(tuple_id)), _node(tuple_id, None, meta, "tuple", F.concat(_ids(ex.TAG_MARK, ex.TAG_DEFINITION), parents))]


def schema_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export whose tags are regions and nations: a nation inherits from its region, every fifth also from ``trade``, regions from ``place``.

    Places declare a segment (options: those in use), a code and a date, nations a balance; customers are tagged by their nation.
    Every seventh nation's tag is in the trash.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, lit = F.col("n_nationkey"), F.lit
    region = [*_tag(_at("R", "r_regionkey"), _at("RM", "r_regionkey"), _at("RX", "r_regionkey"), F.col("r_name"), _ids("P"), F.array(_at("RF", "r_regionkey")), F.concat(lit("the region "), F.col("r_name"))), _node(_at("RF", "r_regionkey"), None, _at("R", "r_regionkey"), "tuple", _ids("LO", "D0"))]
    up = F.concat(F.array(_at("R", "n_regionkey")), F.when(key % 5 == 0, _ids("X")).otherwise(F.array().cast("array<string>")))
    nation = _tag(_at("N", "n_nationkey"), _at("NM", "n_nationkey"), _at("NX", "n_nationkey"), F.col("n_name"), up, F.array(_at("NF", "n_nationkey"), _at("NG", "n_nationkey")))
    nation[0] = _node(_at("N", "n_nationkey"), F.col("n_name"), F.when(key % 7 == 0, "old_TRASH"), "tagDef", F.array(_at("NF", "n_nationkey"), _at("NG", "n_nationkey")))
    nation += [_node(_at("NF", "n_nationkey"), None, _at("N", "n_nationkey"), "tuple", _ids("LB")), _node(_at("NG", "n_nationkey"), None, _at("N", "n_nationkey"), "tuple", F.when(key % 2 == 0, _ids("SYS_A61")).otherwise(_ids("LO")))]
    customer = [
        _node(_at("C", "c_custkey"), F.col("c_name"), None, None, F.array(_at("CS", "c_custkey"), _at("CB", "c_custkey"))),
        _node(_at("CM", "c_custkey"), None, _at("C", "c_custkey"), "metanode", F.array(_at("CT", "c_custkey"))), _node(_at("CT", "c_custkey"), None, _at("CM", "c_custkey"), "tuple", F.array(lit(ex.TAG_MARK), _at("N", "c_nationkey"))),
        _node(_at("CS", "c_custkey"), None, _at("C", "c_custkey"), "tuple", F.array(lit("LS"), F.concat(lit("O:"), "c_mktsegment"))),
        # A tuple within two tuples: the value belongs to the customer.
        _node(_at("CB", "c_custkey"), None, _at("C", "c_custkey"), "tuple", F.array(lit("LN"), _at("CI", "c_custkey"))), _node(_at("CI", "c_custkey"), None, _at("CB", "c_custkey"), "tuple", F.array(lit("LN"), _at("CJ", "c_custkey"))),
        _node(_at("CJ", "c_custkey"), None, _at("CI", "c_custkey"), "tuple", F.array(lit("LB"), _at("CV", "c_custkey"))), _node(_at("CV", "c_custkey"), F.floor("c_acctbal").cast("string"), _at("CJ", "c_custkey")),
    ]
    segments = t("customer").filter("c_mktsegment IS NOT NULL").select("c_mktsegment").distinct()
    option = segments.select(F.inline(F.array(_node(F.concat(lit("O:"), "c_mktsegment"), F.col("c_mktsegment"), lit("LV")))))
    listed = segments.agg(F.sort_array(F.collect_set(F.concat(lit("O:"), "c_mktsegment"))).alias("c")).select(F.inline(F.array(_node(lit("LV"), lit("Values"), lit("LS"), "tuple", F.col("c")))))
    place = [
        *_tag(lit("P"), lit("PM"), lit("PX"), lit("place"), F.array().cast("array<string>"), _ids("PF", "PG", "PH")), *_tag(lit("X"), lit("XM"), lit("XX"), lit("trade"), F.array().cast("array<string>"), _ids("XF")),
        _node(lit("PF"), None, lit("P"), "tuple", _ids("LS")), _node(lit("PG"), None, lit("P"), "tuple", _ids("LC")), _node(lit("PH"), None, lit("P"), "tuple", _ids("SYS_A90")), _node(lit("XF"), None, lit("X"), "tuple", _ids("LB")),
        _node(lit("LS"), lit("Segment"), None, None, _ids("LT", "LV")), _node(lit("LT"), lit("typeChoice"), lit("LS"), "tuple", _ids("SYS_T06", "SYS_D12"), source="SYS_A02"),
        _node(lit("LC"), lit("Phone code")), _node(lit("LO"), lit("Opening date")), _node(lit("LB"), lit("Balance")), _node(lit("LN"), lit("Nested")), _node(lit("D0"), lit("2024-01-01"), lit("RF0")), _node(lit("old_TRASH"), lit("Trash")),
    ]
    parts = [t("region").select(F.inline(F.array(*region))), t("nation").select(F.inline(F.array(*nation))), spread(t("customer"), "c_custkey").select(F.inline(F.array(*customer))), option, listed, spark.range(1).select(F.inline(F.array(*place)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ingested: dict[tuple[str, int, str], tuple[DataFrame, Catalog, es.Declared]] = {}


def ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Catalog, es.Declared]:
    """The export's nodes, written once per session, and the catalog and declarations that are read from them."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _ingested:
        docs = materialize(schema_export(spark, sf_dir))
        cat, d = es.with_schema(docs)
        _ingested[key] = (docs, cat, d)
    return _ingested[key]


#: The declared schema in SQL: live tags, their parents and attributes.
_SCHEMA = f"""WITH RECURSIVE live AS (SELECT 'N:' || n_nationkey AS tag_id, n_name AS tag, n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey % 7 <> 0),
tags(tag_id, tag) AS (SELECT tag_id, tag FROM live UNION ALL SELECT 'R:' || r_regionkey, r_name FROM region UNION ALL VALUES ('P', 'place'), ('X', 'trade')),
parents(child, parent) AS (SELECT tag, r_name FROM live JOIN region ON r_regionkey = r UNION ALL SELECT tag, 'trade' FROM live WHERE k % 5 = 0 UNION ALL SELECT r_name, 'place' FROM region),
declared(tag, field, field_order, kind, evidence) AS (SELECT tag, 'Balance', 0, 'text', 'none' FROM live UNION ALL SELECT tag, CASE WHEN k % 2 = 0 THEN 'Due Date' ELSE 'Opening date' END, 1, 'date', CASE WHEN k % 2 = 0 THEN 'system' ELSE 'name' END FROM live
UNION ALL SELECT r_name, 'Opening date', 0, 'date', 'name' FROM region UNION ALL VALUES ('place', 'Segment', 0, 'options', 'stated'), ('place', 'Phone code', 1, 'text', 'none'), ('place', 'Date', 2, 'date', 'system'), ('trade', 'Balance', 0, 'text', 'none')),
used(tag, field, field_order, kind) AS (SELECT DISTINCT n_name, 'Segment', 1001, 'text' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IS NOT NULL AND n_nationkey % 7 <> 0),
up AS (SELECT child AS tag, parent AS ancestor, 1 AS depth FROM parents UNION ALL SELECT up.tag, p.parent, depth + 1 FROM up JOIN parents p ON p.child = up.ancestor WHERE depth < 10),
anc AS (SELECT tag, ancestor, min(depth) AS depth FROM up GROUP BY ALL)"""


def export(sql: str) -> Callable:
    """Registers a query over the ingested export and its SQL over the tables."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*ingested(spark, sf_dir))
        ORACLE_SQL[f.__name__] = f"{_SCHEMA} {sql}"
        return f

    return register


@export(f"SELECT tag_id, tag, {_KEY.format('tag')} AS key, CASE WHEN starts_with(tag_id, 'R:') THEN 'the region ' || tag END AS description FROM tags")
def declared_tags(docs, cat, d):
    return d.tags.select("tag_id", "tag", "key", "description")


@export("SELECT tag, field, field_order, CASE WHEN tag IN (SELECT r_name FROM region) THEN '2024-01-01' END AS default_value FROM declared")
def declared_fields(docs, cat, d):
    return d.fields.select("tag", "field", "field_order", "default_value")


@export("SELECT DISTINCT 'LS' AS label_id, c_mktsegment AS option FROM customer WHERE c_mktsegment IS NOT NULL")
def declared_options(docs, cat, d):
    return d.options


@export("SELECT tag, field, kind, evidence FROM declared")
def declared_types(docs, cat, d):
    return es.field_types(d, cat)


@export("SELECT field_id, tag_id FROM (SELECT 'SYS_A61' AS field_id, tag_id FROM live WHERE k % 2 = 0 UNION ALL SELECT 'SYS_A90', 'P')")
def system_sources(docs, cat, d):
    return d.sources


_SYSTEM = """, every AS (SELECT tag, field, tag AS origin, 0 AS depth, field_order, kind FROM declared UNION ALL SELECT tag, field, tag, 0, field_order, kind FROM used UNION ALL SELECT anc.tag, f.field, f.tag, anc.depth, f.field_order, f.kind FROM anc JOIN (SELECT tag, field, field_order, kind FROM declared UNION ALL SELECT * FROM used) f ON f.tag = anc.ancestor),
sys(tag, field) AS (SELECT tag, 'Due Date' FROM live WHERE k % 2 = 0 UNION ALL VALUES ('place', 'Date')), whole AS (SELECT * FROM every UNION ALL SELECT tag, field, tag, 999, 999, 'date' FROM sys UNION ALL SELECT anc.tag, s.field, s.tag, 999, 999, 'date' FROM anc JOIN sys s ON s.tag = anc.ancestor)"""


@export(f"{_SYSTEM} SELECT tag, field, origin, depth, field_order, kind FROM whole QUALIFY row_number() OVER (PARTITION BY tag, field ORDER BY depth, field_order, origin) = 1")
def inherited_fields(docs, cat, d):
    return sc.all_fields(cat, es.system_fields(d))


@export("SELECT tag, ancestor, depth FROM anc")
def declared_ancestors(docs, cat, d):
    return sc.ancestors(cat)


@export("SELECT a, b, count(DISTINCT field) AS shared FROM (SELECT x.tag AS a, y.tag AS b, x.field FROM (SELECT tag, field FROM declared UNION SELECT tag, field FROM used) x JOIN (SELECT tag, field FROM declared UNION SELECT tag, field FROM used) y ON x.field = y.field AND x.tag < y.tag WHERE NOT EXISTS (SELECT 1 FROM anc WHERE (anc.tag = x.tag AND anc.ancestor = y.tag) OR (anc.tag = y.tag AND anc.ancestor = x.tag))) GROUP BY ALL HAVING count(DISTINCT field) >= 3")
def declared_twins(docs, cat, d):
    return sc.missing_inheritance(cat, 3)


@export("SELECT 'C:' || c_custkey AS id, unnest(['Segment', 'Balance']) AS field, unnest([c_mktsegment, floor(c_acctbal)::bigint::varchar]) AS value, 0 AS value_order FROM customer")
def nested_fields(docs, cat, d):
    """Attributes of customers, of which one stands three tuples deep."""
    return cat.fields.filter("startswith(id, 'C:')").select("id", "field", "value", "value_order").filter("field <> 'Nested'")


@export("SELECT 'R:' || r_regionkey AS id, r_name || chr(10) || 'Opening date' || chr(10) || '2024-01-01' AS text FROM region UNION ALL SELECT 'LS', 'Segment' || chr(10) || 'typeChoice' || chr(10) || 'Values' || (SELECT string_agg(chr(10) || s, '' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL))")
def nested_texts(docs, cat, d):
    """Names of regions and of an attribute with what stands below them, two levels deep."""
    flat = ex.flatten(docs)
    return ex.nested_text(flat, flat.filter("startswith(id, 'R:') OR id = 'LS'").select("id"), 2)


# Transcripts


def talk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of the conversations: meetings with a transcript of lines, each with its speaker and start; every ninth meeting is in the trash."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.concat(F.lit("l:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    of = lambda x: F.concat(F.lit(f"{x}"), line)
    lines = [
        _node(line, F.col("text"), _at("t", "conv_id"), "transcriptLine"), _node(of("m"), None, line, "metanode", F.array(of("s"), of("b"))),
        _node(of("s"), None, of("m"), "tuple", F.array(F.lit("SYS_A252"), F.concat(F.lit("who:"), "role"))), _node(of("b"), None, of("m"), "tuple", F.array(F.lit("SYS_A253"), of("v"))), _node(of("v"), (F.col("turn") * 30).cast("string"), of("b")),
    ]
    whole = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]).alias("ls"))
    meeting = [
        _node(_at("c", "conv_id"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")), F.when(F.col("conv_id") % 9 == 0, "x_TRASH")), _node(_at("cm", "conv_id"), None, _at("c", "conv_id"), "metanode", F.array(_at("ct", "conv_id"))),
        _node(_at("ct", "conv_id"), None, _at("cm", "conv_id"), "tuple", F.array(F.lit(et.TRANSCRIPT), _at("t", "conv_id"))), _node(_at("t", "conv_id"), None, None, "transcript", F.col("ls")),
    ]
    who = talk.select("role").distinct().select(F.inline(F.array(_node(F.concat(F.lit("who:"), "role"), F.col("role")))))
    return talk.select(F.inline(F.array(*lines))).unionByName(whole.select(F.inline(F.array(*meeting)))).unionByName(who)


def transcript_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return et.meetings(materialize(talk_export(spark, sf_dir))).select("meeting_id", "meeting", "transcript_id", "n_lines")


def transcript_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in order, with speaker and start."""
    return et.lines(materialize(talk_export(spark, sf_dir))).select("transcript_id", "position", "line_id", F.md5(F.col("text").cast("binary")).alias("digest"), "speaker", "start_time", "end_time")


def transcript_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, their speakers and meetings."""
    return et.search(materialize(talk_export(spark, sf_dir)), ["The"]).select("line_id", "speaker", "meeting_id", "meeting")


def transcript_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback: lines that hold the text anywhere."""
    return et.search(materialize(talk_export(spark, sf_dir)), ["The", "an"], whole_words=False).select("line_id", "speaker", "meeting_id", "meeting")


_HIT = "SELECT 'l:' || conv_id || ':' || turn AS line_id, role AS speaker, CASE WHEN conv_id % 9 <> 0 THEN 'c:' || conv_id END AS meeting_id, CASE WHEN conv_id % 9 <> 0 THEN 'Talk ' || conv_id END AS meeting FROM conversations WHERE "
_WORD = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
QUERIES |= {f.__name__: f for f in (transcript_meetings, transcript_said, transcript_found, transcript_like)}
ORACLE_SQL |= {
    "transcript_meetings": "SELECT 'c:' || conv_id AS meeting_id, 'Talk ' || conv_id AS meeting, 't:' || conv_id AS transcript_id, count(*)::int AS n_lines FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id",
    "transcript_said": "SELECT 't:' || conv_id AS transcript_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS position, 'l:' || conv_id || ':' || turn AS line_id, md5(text) AS digest, role AS speaker, (turn * 30)::varchar AS start_time, NULL::varchar AS end_time FROM conversations",
    "transcript_found": f"{_HIT} list_contains({_WORD}, 'the')",
    "transcript_like": f"{_HIT} contains(lower(text), 'the') AND contains(lower(text), 'an')",
}
