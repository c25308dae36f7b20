"""Secret scans: candidate spans per text, weighed by how many owners hold the same value.

Base kinds are assignments, access keys and long hex runs; the method adds well-known
credential formats.  Each candidate value is hashed; the hashes are counted over the
corpus by distinct repositories and owners.  A value that several owners hold is a widely
copied example; one that looks live and that a single owner holds is live-looking.  What
looks live depends on the kind: a known format does by its shape, a private key by its
body, by which it is also hashed, and an assigned value if it is no run of words.

All of it is DataFrame functions.  Only spans and hashes leave the scan, never the text.
Equal candidates are made distinct per repository before they are counted, so a value that
sits in a third of all rows meets in no single task.

Edge cases: a null or empty text has no spans; a null repository or owner counts as one
unknown; repeated rows are scanned and returned each, and do not raise an owner count;
an empty table gives an empty result; other columns are ignored, whatever their names; very
long texts are scanned whole, and many spans cost little more than in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize

_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Kind, pattern, group of the value and the value's least length, in order of listing (fixed values).
KINDS = (
    ("assign", _ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("format", r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 8),
)
BASE = ("assign", "access", "hex")
#: Behind a private key's header: lines with a colon, then the body as group 1.
_KEY_BODY = r"""(?=(?:\s*+[A-Za-z-]++:[^\n]{0,200}+){0,8}+([A-Za-z0-9+/=\\\s"',]*+))"""
#: Owners from which a value is an example, and from which length letters and digits suffice to look live.
EXAMPLE_OWNERS, LIVE_LENGTH = 3, 16
#: Different characters that a shorter assigned value and a private key's body must have.
LEAST_VARIETY, LEAST_KEY_VARIETY = 5, 16
#: Letter pairs common in words (fixed values); most of a random value's pairs are others.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke ui fr oo ag tt do up va ue sw rd ey ap au nk ck".split()
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdef"
#: Matches that are placed one by one before they are moved as one.
FOLD = 64
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def _spans(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches of a kind with their code point ranges."""
    _, pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    value = F.regexp_extract_all(text, regex, F.lit(group))
    if KINDS[kind][0] == "format":
        body = F.regexp_extract_all(text, F.lit(pattern + _KEY_BODY), F.lit(1))
        bare = lambda x: F.regexp_replace(x, r"""\\[nr]|[\s"',\\]""", "")
        value = F.zip_with(value, body, lambda v, b: F.when(b.rlike("[A-Za-z0-9+/]{40}"), bare(b)).otherwise(v))
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
        value.alias("value"),
    )
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(done: Column, x: Column) -> Column:
        first = done["at"] + x["gap"]
        last = first + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("start"), last.alias("end"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.array_append(done["out"], span).alias("out"))

    # An append copies its array, so runs of FOLD matches are placed by themselves and then moved behind one another.
    hits = F.filter(found, lambda x: x["hit"].isNotNull())  # the last gap, behind the last hit, is dropped
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int")), lambda i: F.aggregate(F.slice(hits, i * FOLD + 1, FOLD), begin, step))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def move(done: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + done["at"]).alias("start"), (x["end"] + done["at"]).alias("end"), x["value"].alias("value")))
        return F.struct((done["at"] + part["at"]).alias("at"), F.array_append(done["out"], moved).alias("out"))

    spans = F.flatten(F.aggregate(parts, start, move)["out"])
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``spans`` (kind number, start, end, value), by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_spans(text, k) for k in range(len(KINDS))])
    by = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"))))
    return docs.select(*keep, by.alias("spans"))


def live_looking(value: Column, kind: Column) -> Column:
    is_kind = lambda name: kind == [k[0] for k in KINDS].index(name)
    variety = F.size(F.array_distinct(F.split(value, "")))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(F.lower(value), i, 2)), lambda p: p.rlike("^[a-z]{2}$"))
    wordy = 2 * F.size(F.filter(pairs, lambda p: p.isin(PAIRS))) > F.size(pairs)
    mixed = (F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    shaped = is_kind("access") | is_kind("format")
    real = ~F.lower(value).rlike(PLACEHOLDERS) & (mixed | shaped | ((variety >= LEAST_VARIETY) & ~wordy))
    header = is_kind("format") & value.startswith("-----BEGIN")  # without a body
    # Of the formats only a key's body is all base64: the others have _, - or a dot.
    key = is_kind("format") & value.rlike("^[A-Za-z0-9+/=]{40,}$")
    return ~header & F.when(key, variety >= LEAST_KEY_VARIETY).otherwise(real)


def judge(docs: DataFrame, keep: list[str], repository: Column, owner: Column) -> DataFrame:
    """``keep`` columns, ``spans`` (without values), ``n_live`` and ``n_examples`` for each row."""
    repo_name, owner_name, row_name = (free_name(docs, x) for x in ("_repo", "_owner", "_row"))
    with_row = docs.withColumn(repo_name, F.coalesce(repository, F.lit("?"))).withColumn(owner_name, F.coalesce(owner, F.lit("?")))
    scanned = scan(with_row, [*keep, repo_name, owner_name]).withColumn(row_name, F.monotonically_increasing_id())
    hashed = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("secret"), live_looking(x["value"], x["kind"]).alias("random")))
    rows = materialize(scanned.select(*keep, repo_name, owner_name, row_name, hashed.alias("spans")))
    each = rows.select(F.col(row_name).alias("row"), F.col(repo_name).alias("repo"), F.col(owner_name).alias("owner"), F.explode("spans").alias("x")).select("row", "repo", "owner", "x.secret", "x.random")
    owners = each.select("secret", "repo", "owner").distinct().groupBy("secret").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    weighed = each.join(owners, "secret").groupBy(F.col("row").alias(row_name)).agg(
        F.count(F.when((F.col("owners") == 1) & F.col("random"), 1)).alias("n_live"),
        F.count(F.when(F.col("owners") >= EXAMPLE_OWNERS, 1)).alias("n_examples"),
        F.max("repos").alias("most_repositories"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(weighed, row_name, "left").select(*keep, "spans", *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_examples", "most_repositories")])


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judge(docs, ["doc_id"], F.concat_ws("/", "source", "lang"), F.col("source"))
    base = len(BASE)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(base)], F.sha2(text(F.filter("spans", lambda x: x["kind"] < base)).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), "n_live", "n_examples", "most_repositories",
    )


def _oracle_sql() -> str:
    parts = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT r, {k} AS kind, h.i AS i, h.first AS first, h.first + length(h.hit) AS last, h.value AS value FROM (
  SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i, 'hit': m[i], 'value': v[i],
    'first': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)}})) AS h
  FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d)) WHERE length(h.value) >= {least}""")
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{x[0]}'" for k, x in enumerate(KINDS)) + " END"
    part = f"{names} || ':' || first || ':' || last"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '?') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
s AS ({' UNION ALL '.join(parts)}),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s JOIN d USING (r) GROUP BY value),
w AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({part}, ',' ORDER BY first, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({part}, ',' ORDER BY first, kind) AS spans,
  count(*) FILTER (owners = 1 AND length(value) >= {LIVE_LENGTH} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(lower(value), '{PLACEHOLDERS}')) AS n_live,
  count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_examples, max(repos) AS most_repositories
  FROM s JOIN o USING (value) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN w USING (r)"""


ORACLE_SQL = _oracle_sql()
