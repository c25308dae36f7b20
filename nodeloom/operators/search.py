"""Full-text search, vectors, entity resolution, transcripts and context scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hit_key, normalize_query, words
from ..storage import materialize

K1, B = 1.2, 0.75
#: Slices of a group that are pruned by themselves.
SLICES = 64


def match_all(docs: DataFrame, terms: Sequence[str], ident: str = "id", text: str = "text") -> DataFrame:
    """Rows whose text has every term as a word: a filter within the row, no index and no shuffle."""
    found = words(F.coalesce(F.col(text), F.lit("")))
    return docs.filter(F.size(F.array_intersect(found, F.array(*[F.lit(t.lower()) for t in terms]))) == len({t.lower() for t in terms}))


def bm25(docs: DataFrame, terms: Sequence[str], ident: str = "id", text: str = "text", limit: int | None = 50) -> DataFrame:
    """(ident, score) of the rows with every term; lengths and document frequencies cover all rows."""
    terms = sorted({t.lower() for t in terms})
    tokens = docs.select(F.col(ident), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t)).cast("double")
    # Two passes are made over what is counted, so the texts are taken apart once.
    rows = materialize(tokens.select(ident, F.size("w").cast("double").alias("len"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    hits = rows.filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = hits.select(ident, F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), ident).limit(limit) if limit else out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: Sequence[float], ident: str, vector: str, k: int | None = 10, least: float | None = None) -> DataFrame:
    """(ident, similarity) of the k vectors most like the query, exactly, with an optional least similarity."""
    similarity = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    out = vectors.select(ident, similarity.alias("similarity"))
    if least is not None:
        out = out.filter(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), ident).limit(k) if k else out


def keep_best(rows: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    """Of each key the row with the highest score, ties by id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), ident))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def exact_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, id) of the names that equal ``queries(query)`` once both are normalised."""
    names = nodes.select("id", normalize_query(F.col("name")).alias("_key")).filter("_key <> ''")
    return queries.select("query", normalize_query(F.col("query")).alias("_key")).join(names, "_key").select("query", "id")


def fuzzy_matches(queries: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """(query, id, name, confidence): names that share a word of two letters or more, by edit distance, 0.95 at most.

    Candidates are found by an equi-join on words; an exact name has confidence 1.
    """
    q = queries.select("query", normalize_query(F.col("query")).alias("q"))
    n = nodes.select("id", "name", normalize_query(F.col("name")).alias("n")).filter("n <> ''")
    by_word = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.split(c, " ")))).filter("length(w) >= 2")
    pairs = by_word(q, "q").join(by_word(n, "n"), "w").select("query", "q", "id", "name", "n").distinct()
    distance = F.levenshtein("q", "n")
    close = F.least(F.lit(0.95), F.greatest(F.lit(0.0), 1 - distance / F.greatest(F.length("q"), F.length("n"))))
    out = pairs.select("query", "id", "name", F.round(F.when(F.col("q") == F.col("n"), 1.0).otherwise(close), 6).alias("confidence"))
    return out.filter(F.col("confidence") >= least)


def resolve(matches: DataFrame, accept: float = 0.85, gap: float = 0.1) -> DataFrame:
    """(query, action, id, confidence) per query: matched if the best is sure enough and clear of the second, else ambiguous."""
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "id")
    ranked = matches.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("confidence").over(order)).filter("_r = 1")
    clear = F.col("_next").isNull() | (F.round(F.col("confidence") - F.col("_next"), 6) >= gap)
    action = F.when((F.col("confidence") >= accept) & clear, "matched").when(F.col("confidence") >= accept, "ambiguous").otherwise("no_match")
    return ranked.select("query", action.alias("action"), "id", "confidence")


def semantic_confidence(similarity: Column) -> Column:
    return F.when(similarity < 0.5, 0.0).otherwise(F.least(F.lit(0.95), (similarity - 0.5) * 1.9))


def relevance(distance: Column, similarity: Column, age_days: Column) -> Column:
    """Graph distance, similarity and recency in one score; without vectors the other two share the weight."""
    near, fresh = 1 / (distance + 1), F.coalesce(F.exp(-age_days / 30), F.lit(0.5))
    return F.when(similarity.isNull(), 0.6 * near + 0.4 * fresh).otherwise(0.4 * near + 0.35 * similarity + 0.25 * fresh)


def within_budget(items: DataFrame, budget: int, group: str, ident: str = "id") -> DataFrame:
    """Greedy choice by falling score: an item that does not fit is skipped, later ones may still fit.

    Of the items of one size at most budget / size are taken, the first ones; the others are dropped before a
    group becomes an array, first within slices of a group.  Items without tokens always fit and are added apart.
    Tokens are not negative.
    """
    rows = items.select(group, (-F.col("score")).alias("order"), F.col(ident).alias("id"), F.col("tokens"))
    slim = rows.filter((F.col("tokens") > 0) & (F.col("tokens") <= budget)).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    for part in ([group, "tokens", "slice"], [group, "tokens"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("order", "id"))
        slim = slim.withColumn("_r", rank).filter(F.col("_r") * F.col("tokens") <= budget).drop("_r")
    entry = F.struct("order", "id", "tokens")
    kind = slim.select(entry.alias("x")).schema["x"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))

    def step(done: Column, x: Column) -> Column:
        fits = done["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, done["used"] + x["tokens"]).otherwise(done["used"]).alias("used"), F.when(fits, F.array_append(done["taken"], x)).otherwise(done["taken"]).alias("taken"))

    chosen = slim.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(entry)), start, step)["taken"].alias("c")).select(group, F.inline("c"))
    every = chosen.unionByName(rows.filter((F.col("tokens") == 0) & F.lit(budget >= 0)))
    position = F.row_number().over(Window.partitionBy(group).orderBy("order", "id", "tokens")) - 1
    used = F.sum(F.col("tokens").cast("long")).over(Window.partitionBy(group))
    return every.select(group, used.alias("used"), position.alias("position"), "id")


def running_budget(items: DataFrame, budget: int, group: str, ident: str = "id") -> DataFrame:
    """Items by falling score while the sum before them is below the budget; the last may overshoot."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(group).orderBy(F.desc("score"), ident).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("before", before).filter(F.col("before") < budget)


def transcripts(lines: DataFrame) -> DataFrame:
    """(conv_id, lines, speakers, opening) per conversation of ``lines(conv_id, turn, role, text)``."""
    return lines.groupBy("conv_id").agg(F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"), F.min_by("text", F.struct("turn", "role", "text")).alias("opening"))


def transcript_search(lines: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Matching lines with their speaker and the number of matches in the conversation."""
    hits = match_all(lines, terms)
    return hits.select("conv_id", "turn", "role", "text").join(hits.groupBy("conv_id").agg(F.count("*").alias("matches")), "conv_id")


#: Keys (a word and a gram) that may be broadcast; beyond, the join is a shuffle.
BROADCAST_KEYS = 100_000


def match_phrase(docs: DataFrame, phrase: str, text: str = "text") -> DataFrame:
    """Rows whose words hold the phrase's words one after another."""
    wanted = " ".join(w for w in "".join(c if c.isalnum() else " " for c in phrase.lower()).split())
    joined = F.concat(F.lit(" "), F.array_join(words(F.coalesce(F.col(text), F.lit(""))), " "), F.lit(" "))
    return docs.filter(joined.contains(f" {wanted} "))


def postings(docs: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """(term, ident, tf, len): the index that later searches read instead of the texts, counted within each row."""
    w = words(F.coalesce(F.col(text), F.lit("")))
    each = docs.select(F.col(ident), w.alias("w")).select(ident, F.size("w").alias("len"), F.explode("w").alias("term"))
    return each.groupBy("term", ident, "len").agg(F.count("*").alias("tf"))


def index_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of rows and their mean length in words."""
    return docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size(words(F.coalesce(F.col(text), F.lit(""))))).alias("avg_len"))


def bm25_indexed(index: DataFrame, size: DataFrame, terms: Sequence[str], ident: str = "id", limit: int | None = 50) -> DataFrame:
    """(ident, score) of the rows with every term, from ``postings``; only the terms' rows are read."""
    terms = sorted({t.lower() for t in terms})
    hits = index.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(size)).withColumn("part", part)  # as many rows as terms, and one
    out = scored.groupBy(ident).agg(F.count("*").alias("met"), F.round(F.sum("part"), 6).alias("score")).filter(F.col("met") == len(terms)).select(ident, "score")
    return out.orderBy(F.desc("score"), ident).limit(limit) if limit else out


def least_score(text: str | None) -> float | None:
    """A least similarity from text: a whole number above 1 is a percentage; 0 to 1 at the ends; None if it is no number."""
    try:
        value = float(text.strip().rstrip("%"))
    except (AttributeError, ValueError):
        return None
    return max(0.0, min(1.0, value / 100 if value > 1 and "." not in text else value))


def semantic_search(hits: DataFrame, nodes: DataFrame, limit: int = 20, least: float | None = None, tag: str | None = None, trash: DataFrame | None = None) -> DataFrame:
    """(id, name, similarity, tags) of the best ``hits(id, similarity)`` among ``nodes(id, name, tags)``.

    Before the cut: hits below ``least``, without a name, without the asked tag, in ``trash(id)`` and bare references are dropped,
    and of hits with one name and the same tags the best stays.
    """
    rows = hits if least is None or least <= 0 else hits.filter(F.col("similarity") >= least)
    rows = rows.join(nodes, "id").filter("trim(coalesce(name, '')) <> ''")
    rows = rows if tag is None else rows.filter(F.array_contains("tags", tag))
    rows = rows if trash is None else rows.join(trash.select("id").distinct(), "id", "left_anti")
    rows = rows.filter(~(F.col("name").contains("[[") & F.col("name").contains("]]")))
    best = rows.groupBy(hit_key(F.col("name"), F.col("tags")).alias("_key")).agg(F.min(F.struct((-F.col("similarity")).alias("far"), "id", "name", "tags")).alias("x"))
    return best.select("x.id", "x.name", (-F.col("x.far")).alias("similarity"), "x.tags").orderBy(F.desc("similarity"), "id").limit(limit)


def enrich_hits(hits: DataFrame, key: str, score: str, ident: str, limit: int) -> DataFrame:
    """Hits whose name is no bare reference, the best of each key, the first ``limit`` of them."""
    shown = hits.filter(~(F.col("name").contains("[[") & F.col("name").contains("]]")))
    return keep_best(shown, key, score, ident).orderBy(F.desc(score), ident).limit(limit)


def variants(queries: DataFrame) -> DataFrame:
    """``queries(query)`` with each ``variant``: itself, ``Last, First`` turned round, two words the other way."""
    part = F.transform(F.split("query", ","), lambda x: F.trim(x))
    two = F.split(F.trim("query"), r"\s+")
    turned = F.when((F.size(part) == 2) & (part[0] != "") & (part[1] != ""), F.concat(part[1], F.lit(" "), part[0]))
    swapped = F.when((F.size(two) == 2) & ~F.col("query").contains(","), F.concat(two[1], F.lit(", "), two[0]))
    return queries.select("query", F.explode(F.array_distinct(F.array_compact(F.array("query", turned, swapped)))).alias("variant"))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(size))))


def containing(words_: DataFrame, names: DataFrame) -> DataFrame:
    """(w, id) of ``names(id, l)`` whose text holds a word of ``words_(w)``, of two characters or more, anywhere.

    A text that holds a word holds all its runs of three characters (the word itself, if it has two), so one of them, the one that
    the fewest texts hold, finds all; the text decides.  Of the texts' runs only those that words have are shuffled.
    """
    w = words_.select("w").filter("length(w) >= 2").distinct()
    parts = w.select("w", F.explode(F.when(F.length("w") == 2, F.array("w")).otherwise(_grams(F.col("w"), 3))).alias("g"))
    grams = materialize(parts.select("g").distinct())
    few = F.broadcast(grams) if grams.count() <= BROADCAST_KEYS else grams
    every = names.select("id", F.explode(F.array_union(_grams(F.col("l"), 2), _grams(F.col("l"), 3))).alias("g"))
    held = materialize(every.join(few, "g", "left_semi"))
    rare = held.groupBy("g").agg(F.count("*").alias("n"))
    key = parts.join(rare, "g", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).filter("x.n > 0").select("w", "x.g")
    met = held.join(key, "g").select("w", "id").join(names.select("id", "l"), "id")
    return met.filter(F.col("l").contains(F.col("w"))).select("w", "id")


def candidates(queries: DataFrame, nodes: DataFrame, tag: str | None = None, limit: int = 100, short: bool = False, semantic: DataFrame | None = None) -> DataFrame:
    """(query, id, name, confidence, how) of ``nodes(id, name, tags, entity)`` for ``queries(query)``, the best way to each node.

    Exact names have 1.0.  Others must hold a word (two characters or more) of a variant of the query; of these the
    ``limit`` closest by edit distance count, a tenth more with the asked tag, half as much for entities, 0.95 at most.
    semantic: ``(query, id, similarity)`` of vectors, which count by ``semantic_confidence``.
    Queries under three characters have none unless a tag is given or ``short`` is set.  Any number of queries may be asked.
    """
    asked = variants(queries).withColumn("q", normalize_query(F.col("variant"))).filter("q <> ''")
    own = normalize_query(F.col("query"))
    asked = asked if short or tag else asked.filter(F.length(own) >= 3)
    named = nodes.filter("name IS NOT NULL").withColumn("n", normalize_query(F.col("name"))).withColumn("l", F.lower("name"))
    if tag is not None:
        named = named.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    exact = asked.join(named, asked.q == named.n).select("query", "id", "name", F.lit(1.0).alias("confidence"), F.lit("exact").alias("how"))
    word = materialize(asked.select("query", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("w")).filter("length(w) >= 2"))
    pairs = word.join(containing(word, named), "w").select("query", "q", "id").distinct().join(named.select("id", "name", "l", "entity"), "id")
    distance = F.levenshtein("q", "l")
    close = 1 - distance / F.greatest(F.length("q"), F.length("name")) + (0.1 if tag else 0.0) + F.when(F.col("entity"), 0.05).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("query", "q").orderBy("distance", "id"))
    fuzzy = pairs.withColumn("distance", distance).withColumn("_r", rank).filter(F.col("_r") <= limit)
    fuzzy = fuzzy.select("query", "id", "name", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), close)), 6).alias("confidence"), F.lit("fuzzy").alias("how"))
    every = exact.unionByName(fuzzy)
    if semantic is not None:
        meant = semantic.join(named.select("id", "name"), "id").select("query", "id", "name", F.round(semantic_confidence(F.col("similarity")), 6).alias("confidence"), F.lit("semantic").alias("how"))
        every = every.unionByName(meant)
    best = F.max(F.struct("confidence", "how", "name")).alias("x")
    return every.filter("confidence > 0").groupBy("query", "id").agg(best).select("query", "id", "x.name", "x.confidence", "x.how")


def worth_a_vector(name: Column, tag: Column, entity: Column, system: Sequence[str], least: int = 15) -> Column:
    """Long enough a name or an entity, no date of zero time, no bare reference, no system kind."""
    return name.isNotNull() & ((F.length(name) >= least) | entity) & ~name.startswith("1970-01-01") & ~(name.contains("[[") & name.contains("]]")) & ~tag.isin(list(system))


def content_candidates(nodes: DataFrame, entity: Column, system: Sequence[str], least: int = 15) -> DataFrame:
    """Nodes (name, tag, ...) that are worth a vector."""
    return nodes.filter(worth_a_vector(F.col("name"), F.col("tag"), entity, system, least))
