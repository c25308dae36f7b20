"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the
input.  Each document draws its count from a Poisson distribution with that mean by
inverting the distribution function at a uniform number hashed from seed and id, so the
draw does not depend on partitioning, order or retries.  A mean above MAX_RATE, whose
distribution would underflow, is drawn as the sum of equal parts below it, each with a
number hashed from the part too.  The document is exploded by its count, and a hash of seed, id and replica deals the rows to partitions and orders them
there: a global shuffle in one exchange, without a sampling pass and without a hot key.

Edge cases: rows without source form a source of their own; a row without id draws by its
text; repeated ids draw alike; a rate has no bound, but asking for more than MAX_RATE
times the input is an error; an empty table gives an empty result; other columns go along,
whatever their names; texts of any length are copied as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

MAX_RATE, SEED, TEMPERATURE = 500, 17, 0.5
#: Rows of the rate table that may be broadcast; beyond, the join is a shuffle that Spark may split by skew.
BROADCAST_SOURCES = 100_000
_UNIT = 1 << 52


def tempered_weights(docs: DataFrame, source: str = "source", exponent: float = TEMPERATURE) -> DataFrame:
    """(source, weight): the sources' row counts to a power, which lifts small sources."""
    return docs.groupBy(source).agg(F.pow(F.count("*").cast("double"), F.lit(exponent)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source: str = "source", size: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): the mean count, to get ``size`` times the input's rows, and the distribution function of each of its equal parts."""
    counts = docs.groupBy(source).agg(F.count("*").alias("n"))
    known = counts.join(weights.withColumnRenamed(source, "_source"), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    total = known.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))  # one row
    rate = F.lit(size) * F.col("all_n") * F.col("weight") / F.col("all_weight") / F.col("n")
    found = known.join(F.broadcast(total)).select(source, rate.alias("rate"))
    found = found.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), (mean + 12 * F.sqrt(mean) + 30).cast("int"))

    def step(done: Column, k: Column) -> Column:
        p = done["p"] * mean / k
        c = done["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(done["cdf"], c).alias("cdf"))

    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf"))
    return found.withColumn("cdf", F.aggregate(steps, start, step)["cdf"])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(_UNIT))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", ident: str = "doc_id", size: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; adds ``replica`` (from 1) and ``shuffle_key``.

    Where ``docs`` has columns of these names, the added ones have underscores in front.
    """
    if size > MAX_RATE:
        raise ValueError(f"a rate above {MAX_RATE} for the average document")
    key, parts, cdf, count = (free_name(docs, x) for x in ("_source", "_parts", "_cdf", "_count"))
    replica, shuffle_key = free_name(docs, "replica"), free_name(docs, "shuffle_key")
    table = rates(docs, tempered_weights(docs, source) if weights is None else weights, source, size).select(F.col(source).alias(key), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(ident).cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    draw = below(uniform(F.lit(str(seed)), name))
    more = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda k: below(uniform(F.concat(F.lit(f"{seed}/"), k.cast("string")), name)))
    draw = F.when(F.col(parts) == 1, draw).otherwise(F.aggregate(more, draw, lambda a, b: a + b))
    drawn = docs.join(table, F.col(source).eqNullSafe(F.col(key))).withColumn(count, draw)
    each = drawn.filter(F.col(count) > 0).drop(cdf, parts, key).withColumn(replica, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count)
    each = each.withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(f"{seed}+"), name, F.col(replica)).cast("binary")))
    return each.repartition(shuffle_key).sortWithinPartitions(shuffle_key, ident)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


def oracle_sql(table: str = "documents", size: float = 1.0, seed: int = SEED) -> str:
    name = "coalesce(doc_id::varchar, md5(coalesce(text, '')))"
    return f"""WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::double, {TEMPERATURE}) AS weight FROM {table} GROUP BY source),
r AS (SELECT source, {size}::double * (sum(n) OVER ())::bigint * weight / sum(weight) OVER () / n AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < (floor(rate + 12 * sqrt(rate) + 30))::int),
l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, {name} AS name, l.cdf, ('0x' || substr(md5('{seed}:' || {name}), 1, 13))::bigint / {float(_UNIT)!r} AS u FROM {table} d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, text, lang, source, n_chars, name, unnest(range(1, len(list_filter(cdf, lambda x: x <= u)) + 1)) AS replica FROM d)
SELECT doc_id, text, lang, source, n_chars, replica::int AS replica, md5('{seed}+:' || name || ':' || replica) AS shuffle_key FROM e"""


ORACLE_SQL = oracle_sql()
