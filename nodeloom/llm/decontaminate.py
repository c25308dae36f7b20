"""Benchmark decontamination by template windows.

Words are canonicalised: numbers, names (capitalised words inside a sentence) and units
(unit words behind a number) become typed placeholders.  Eight-word windows of the
template are hashed and joined between documents and benchmark, and so are those of the
lower-cased words, as names are found by their capitals; matches are gathered by
alignment (document, item, offset).  An alignment is contamination if it covers enough
of the item, or a long enough stretch of it, and if its slots are consistent: one slot
value of the item always stands for one value in the document, wherever its windows
match.  That also catches questions asked again with other numbers or names.

All of it is DataFrame functions.  The benchmark's windows are broadcast only after their
count is checked; beyond the bound both sides are shuffled by hash.  The ids of documents whose
slots are looked at again are broadcast up to BROADCAST_DOCS; only beyond are documents shuffled as text.

Edge cases: null and empty texts have no windows; an item shorter than a window is one
window of its own length; repeated rows count once; null ids are left out; very long texts take all their
windows; of alignments alike in windows the one by templates, then with fewer changed words, then of the smallest offset is
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WINDOW, MIN_SHARE, MIN_RUN = 8, 0.8, 13
#: Windows of the benchmark that may be broadcast (about 100 MB at most).
BROADCAST_WINDOWS = 1_000_000
#: Ids of documents that may be broadcast.
BROADCAST_DOCS = 500_000
#: Unit words (fixed values).
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees".split()
_NAME = r"([\p{Ll},;] )(\p{Lu}\p{Ll}+)"
_NUMBER = r"(\p{N})[.,](\p{N})"
_WORD = r"@?[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased; a name starts with @, a number is joined by underscores."""
    s = F.coalesce(text, F.lit(""))
    for _ in range(2):  # names next to each other
        s = F.regexp_replace(s, _NAME, "$1@$2")
    s = F.lower(s)
    for _ in range(2):
        s = F.regexp_replace(s, _NUMBER, "$1_$2")
    return F.regexp_extract_all(s, F.lit(_WORD), F.lit(0))


def slots_of(words: Column) -> Column:
    """Of each word: its placeholder, or the word itself."""
    number = lambda w: F.substring(w, 1, 1).between("0", "9") & w.rlike("^[0-9_]+$")

    def slot(w: Column, i: Column) -> Column:
        unit = w.isin(UNITS) & (i > 0) & number(F.get(words, i - 1))
        return F.when(F.substring(w, 1, 1) == "@", "@").when(number(w), "#").when(unit, "%").otherwise(w)

    return F.transform(words, slot)


def windows(rows: DataFrame, ident: str, sizes: list[int], own: bool = False) -> DataFrame:
    """(ident, at, template, literal): hashes of each window of the placeholders and of the words in lower case.

    own: a text takes windows of ``sizes[0]``, or if it is shorter the one of its own length.
    """
    cut = rows.filter(F.col(ident).isNotNull()).select(ident, words_of(F.col("text")).alias("words"))
    hashed = cut.select(ident, F.transform(slots_of(F.col("words")), lambda w: F.xxhash64(w)).alias("t"), F.transform("words", lambda w: F.xxhash64(F.ltrim(w, F.lit("@")))).alias("w"))

    def of(size: int) -> Column:
        takes = F.size("t") == size if own and size != sizes[0] else F.size("t") >= size
        starts = F.when(takes, F.sequence(F.lit(0), F.size("t") - size)).otherwise(F.array().cast("array<int>"))
        hashes = lambda name, i: F.xxhash64(F.lit(size), *[F.get(F.col(name), i + k) for k in range(size)])
        return F.transform(starts, lambda i: F.struct(i.alias("at"), hashes("t", i).alias("template"), hashes("w", i).alias("literal")))

    return hashed.select(ident, F.inline(F.concat(*[of(s) for s in sizes]) if len(sizes) > 1 else of(sizes[0])))


def _keyed(cut: DataFrame) -> DataFrame:
    """Each window under its template and, where it has placeholders, under its words."""
    keys = F.when(F.col("template") == F.col("literal"), F.array("template")).otherwise(F.array("template", "literal"))
    return cut.withColumn("key", F.explode(keys))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, share, reworded) of each contaminated pair, by its best alignment.

    Alignments by templates go before those by words alone.
    """
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct()
    length = F.size(words_of(F.col("text")))
    short = [r.n for r in items.select(length.alias("n")).filter((F.col("n") > 0) & (F.col("n") < window)).distinct().orderBy("n").collect()]  # window - 1 rows at most
    sizes = [window, *short]
    # An item takes windows of the full size, or the one of its own length.
    need = items.groupBy("item_id").agg(F.max(length).alias("n")).withColumn("item_windows", F.greatest(F.lit(1), F.col("n") - window + 1))
    own = _keyed(windows(items, "item_id", sizes, own=True)).join(need, "item_id").withColumnRenamed("at", "item_at").distinct()
    if own.count() <= BROADCAST_WINDOWS:
        own = F.broadcast(own)
    hits = _keyed(windows(docs, "doc_id", sizes)).join(own.withColumnsRenamed({"literal": "item_literal", "template": "item_template"}), "key")
    shift = F.col("at") - F.col("item_at")
    like, same = F.col("template") == F.col("item_template"), F.col("literal") == F.col("item_literal")
    found = hits.groupBy("doc_id", "item_id", shift.alias("shift")).agg(
        F.collect_set(F.when(like, F.col("item_at"))).alias("alike"), F.collect_set(F.when(same, F.col("item_at"))).alias("copied"),
        F.max("item_windows").alias("item_windows"), F.max((like & ~same).cast("int")).alias("reworded"),
    )
    # Each alignment by its templates and, whatever the case, by its words alone.
    way = lambda by, matched, reworded: F.struct(F.lit(by).alias("by"), F.col(matched).alias("matched"), reworded.alias("reworded"))
    ways = F.array(way("template", "alike", F.col("reworded")), way("copy", "copied", F.lit(0)))
    found = found.select("doc_id", "item_id", "shift", "item_windows", F.inline(ways)).withColumn("windows", F.size("matched").cast("long"))
    share = F.col("windows") / F.col("item_windows")
    # Used twice below, and small beside the documents: written once.
    found = materialize(found.filter((share >= min_share) | (F.col("windows") >= min_run - window + 1)).withColumn("share", share))
    bad = _inconsistent(docs, items, found.filter("reworded = 1").select("doc_id", "item_id", "shift", "matched"), window)
    found = found.join(bad.withColumn("by", F.lit("template")), ["doc_id", "item_id", "shift", "by"], "left_anti")
    best = F.max_by(F.struct("windows", "item_windows", "share", "reworded"), F.struct(F.col("by") == "template", "windows", -F.col("reworded"), -F.col("shift")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.windows").alias("windows"), F.col("b.item_windows").cast("long").alias("item_windows"), F.col("b.share").alias("share"), F.col("b.reworded").alias("reworded"))


def _inconsistent(docs: DataFrame, items: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """The alignments in whose matched windows one slot value of the item stands for several values in the document."""
    asked = pairs.select("doc_id").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_DOCS else asked
    theirs = docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", words_of(F.col("text")).alias("theirs"))
    ours = items.select("item_id", words_of(F.col("text")).alias("ours"))
    both = pairs.join(theirs, "doc_id").join(ours, "item_id")
    each = both.withColumn("slots", slots_of(F.col("ours"))).select("doc_id", "item_id", "shift", "matched", "theirs", F.posexplode(F.arrays_zip("ours", "slots")).alias("i", "x"))
    covered = F.exists("matched", lambda at: F.col("i").between(at, at + window - 1))
    stands = F.ltrim(F.get("theirs", F.col("i") + F.col("shift")), F.lit("@"))
    each = each.filter(F.col("x.slots").isin("@", "#", "%") & covered).select("doc_id", "item_id", "shift", F.col("x.ours").alias("value"), stands.alias("stands"))
    return each.groupBy("doc_id", "item_id", "shift", "value").agg(F.count_distinct("stands").alias("n")).filter("n > 1").select("doc_id", "item_id", "shift").distinct()


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle_sql(window: int = WINDOW) -> str:
    name = _NAME
    text = "coalesce(text, '')"
    for _ in range(2):
        text = f"regexp_replace({text}, '{name}', '\\1@\\2', 'g')"
    text = f"lower({text})"
    for _ in range(2):
        text = f"regexp_replace({text}, '{_NUMBER}', '\\1_\\2', 'g')"
    words = f"regexp_extract_all({text}, '{_WORD}')"
    units = ", ".join(f"'{u}'" for u in UNITS)
    number = lambda w: f"regexp_matches({w}, '^[0-9][0-9_]*$')"
    slots = f"list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i][1] = '@' THEN '@' WHEN {number('w[i]')} THEN '#' WHEN w[i] IN ({units}) AND i > 1 AND {number('w[i - 1]')} THEN '%' ELSE w[i] END)"

    def cut(table: str, ident: str) -> str:
        return f"(SELECT {ident}, w, {slots} AS t FROM (SELECT DISTINCT {ident}, {words} AS w FROM {table} WHERE {ident} IS NOT NULL))"

    def wins(table: str, ident: str, size: str) -> str:
        return f"SELECT {ident}, pos, {size} AS size, array_to_string(t[pos:pos + {size} - 1], ' ') AS template, array_to_string(w[pos:pos + {size} - 1], ' ') AS literal FROM (SELECT {ident}, t, w, size, unnest(range(1, len(t) - {size} + 2)) AS pos FROM {table})"

    return f"""WITH b AS {cut('benchmark', 'item_id')}, d AS {cut('documents', 'doc_id')},
need AS (SELECT item_id, max(len(w)) AS n, greatest(1, max(len(w)) - {window - 1}) AS item_windows FROM b GROUP BY item_id),
sizes AS (SELECT {window} AS size UNION SELECT len(w) FROM b WHERE len(w) > 0 AND len(w) < {window}),
bs AS (SELECT * FROM b, sizes), dz AS (SELECT * FROM d, sizes),
own AS (SELECT DISTINCT x.item_id, x.pos AS item_at, x.size, x.template, x.literal AS item_literal, n, item_windows FROM ({wins('bs', 'item_id', 'size')}) x JOIN need USING (item_id) WHERE n >= {window} OR x.pos = 1),
hits AS (SELECT doc_id, item_id, pos - item_at AS shift, item_at, item_windows, literal <> item_literal AS other FROM ({wins('dz', 'doc_id', 'size')}) JOIN own USING (size, template)),
f AS (SELECT doc_id, item_id, shift, count(DISTINCT item_at) AS windows, max(item_windows) AS item_windows, max(other::int) AS reworded FROM hits GROUP BY ALL),
g AS (SELECT *, windows / item_windows AS share FROM f WHERE windows / item_windows >= {MIN_SHARE} OR windows >= {MIN_RUN - window + 1}),
e AS (SELECT g.doc_id, g.item_id, shift, b.w[i] AS value, d.w[i + shift] AS stands FROM g JOIN d ON g.doc_id = d.doc_id JOIN b ON g.item_id = b.item_id, unnest(range(1, len(b.w) + 1)) AS u(i) WHERE reworded = 1 AND b.t[i] IN ('@', '#', '%')),
bad AS (SELECT DISTINCT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift, value FROM e GROUP BY ALL HAVING count(DISTINCT stands) > 1)),
ok AS (SELECT * FROM g ANTI JOIN bad USING (doc_id, item_id, shift))
SELECT doc_id, item_id, windows, item_windows::bigint AS item_windows, share, reworded FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY windows DESC, reworded, shift) = 1"""


ORACLE_SQL = _oracle_sql()
