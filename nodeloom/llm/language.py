"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms, per language:

* the text: hashed byte trigrams under multinomial models, tempered by length;
* the language that the markup declares, by how often each declaration goes with each language;
* the address's suffix, weighed the same way;
* the host's prior: soft counts of its other pages, smoothed towards its domain, the
  domain towards its suffix, the suffix towards the whole corpus.

Everything corpus-wide is a grouped aggregation with partial sums, so a host with a
third of all pages meets in no single task.  What the aggregations say goes back to the pages by joins: declarations,
suffixes and hosts of HOT pages or more are broadcast once counted, so no page of theirs is shuffled by a hot key;
other hosts are joined by key.  The text models are fitted on at most about ``max_docs`` documents of declared language, as
many of each, for the MAX_LANGUAGES languages with most documents; further ones have neutral text evidence and
are told by the rest.

Edge cases: null or empty pages have no text evidence and go by the rest; a missing
declaration or host is a value of its own; repeated rows count each; of equal posteriors the
language first by name is taken; very long pages are read whole; without languages to
learn from the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import materialize

BUCKETS, MAX_DOCS, SEED = 1 << 16, 20_000, 5
#: Languages with a model of their text, strength of the smoothing, weight of a trigram and the most that text may say.
MAX_LANGUAGES, STRENGTH, TEMPER, TEXT_LIMIT = 200, 4.0, 0.2, 12.0
#: Pages from which a host is hot, and rows that may be broadcast.
HOT, BROADCAST_ROWS = 50_000, 20_000
_HASH = 1 << 53
_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
_DECLARED = r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})"""


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each byte trigram inside a document; digits and symbols are one separator."""
    low = np.where(tk.WORDS[data] > 0, tk.LOWER[data], np.uint8(32))
    low[(low >= 48) & (low <= 57)] = 32
    if len(low) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = low.astype(np.uint64)
    code = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    doc = np.searchsorted(offsets, np.arange(len(code)), side="right") - 1
    keep = (np.arange(len(code)) + 2 < offsets[doc + 1]) & ((low[:-2] != 32) | (low[1:-1] != 32))
    return (tk.mix(code[keep]) & np.uint64(BUCKETS - 1)).astype(np.int64), doc[keep]


class TextModels:
    """Log probabilities of the buckets under each language, centred on their mean.

    modelled: places in ``languages`` of those that ``counts`` has a row for; all by default.
    """

    def __init__(self, languages: list[str], counts: np.ndarray, modelled: list[int] | None = None):
        self.languages = languages
        self.modelled = list(range(len(languages))) if modelled is None else modelled
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        logs = np.log(share)
        self.weights = (logs - logs.mean(axis=0)).astype(np.float32)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_docs = len(offsets) - 1
        bucket, doc = trigram_counts(data, offsets)
        out = np.zeros((n_docs, len(self.languages)))
        for i, w in zip(self.modelled, self.weights, strict=True):
            out[:, i] = np.bincount(doc, weights=w[bucket], minlength=n_docs)
        out = TEMPER * (out - out.max(axis=1, keepdims=True))
        return np.maximum(out, -TEXT_LIMIT)


def fit_text(docs: DataFrame, max_docs: int = MAX_DOCS) -> TextModels | None:
    """Text models from ``docs(doc_id, text, lang)``; languages are those with declared documents, a row of each of which comes to the driver."""
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    found = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return None
    every = sorted(found)
    languages = sorted(sorted(every, key=lambda x: -found[x])[:MAX_LANGUAGES])
    sizes = {x: found[x] for x in languages}
    # Each language's share of the sample is the same; the hash has as many bits as a double is exact to.
    quota = [(x, int(_HASH * min(1.0, max_docs / len(sizes) / n))) for x, n in sizes.items()]
    below = F.create_map(*[F.lit(v) for pair in quota for v in pair])[F.col("lang")]
    sample = known.filter(F.col("lang").isin(languages)).filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(_HASH)) < below)
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last, data, offsets in tk.chunks(batch):
                bucket, doc = trigram_counts(data, offsets)
                total += np.bincount(lang[first:last][doc] * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    summed = sample.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(languages) * BUCKETS)
    got = summed.toPandas()  # MAX_LANGUAGES * BUCKETS cells at most
    counts[got.cell.to_numpy(np.int64)] = got.n
    return TextModels(every, counts.reshape(len(languages), BUCKETS), [every.index(x) for x in languages])


def text_evidence(pages: DataFrame, models: TextModels, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``e`` (array of log evidence by language) of the column ``text``."""
    held = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = np.concatenate([held.value.evidence(data, offsets) for _, _, data, offsets in tk.chunks(batch)])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * e.shape[1]), pa.array(e.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=[*keep, "e"])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep) + "e array<double>"
    return pages.select(*keep, "text").mapInArrow(run, schema)


def identify(pages: DataFrame, models: TextModels, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(ident, host, declared, lang, posterior, text_lang) for each page."""
    n = len(models.languages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    cut = pages.select(
        F.col(ident), host.alias("host"), F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), _DECLARED, 1)).alias("declared"), F.regexp_replace(F.coalesce(html, F.lit("")), _MARKUP, " ").alias("text"),
    )
    keep = [ident, "host", "domain", "suffix", "declared"]
    rows = text_evidence(cut, models, keep)
    # Posteriors of the text alone are the soft counts.
    weight = F.transform("e", F.exp)
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    rows = materialize(rows.withColumn("q", F.transform(weight, lambda x: x / total)))
    q = [F.get("q", i) for i in range(n)]

    def counts(*by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array(*[F.sum(x) for x in q]).alias("c"))

    def smoothed(level: DataFrame, above: DataFrame, by: list[str], name: str) -> DataFrame:
        """Share of each language, the level above counting as STRENGTH pages."""
        joined = level.join(above, by) if by else level.join(F.broadcast(above))  # above: one row
        n_level = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        share = F.zip_with("c", "prior", lambda c, p: (c + STRENGTH * p) / (n_level + STRENGTH))
        return joined.select(*[x for x in level.columns if x != "c"], *(["c"] if name == "host" else []), (F.col("prior") if name == "host" else share).alias("prior"))

    whole = rows.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(q)])
    every = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    prior = whole.select(F.array(*[(F.col(f"s{i}") + 1.0) / (every + float(n)) for i in range(n)]).alias("prior"))
    suffixes = smoothed(counts("suffix"), prior, [], "suffix")
    domains = smoothed(counts("suffix", "domain"), suffixes, ["suffix"], "domain")
    hosts = smoothed(counts("suffix", "domain", "host"), domains, ["suffix", "domain"], "host")

    def likelihood(by: str, name: str) -> DataFrame:
        """Log of how much oftener each language goes with this value than its share."""
        each = counts(by).join(F.broadcast(prior))
        n_each = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        return each.select(by, F.zip_with("c", "prior", lambda c, p: F.log((c + STRENGTH * p) / (n_each + STRENGTH) / p)).alias(name))

    def small(df: DataFrame) -> DataFrame:
        df = materialize(df)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    # Pages of hot hosts stay where they are; as many hosts as there are pages for can be hot.
    keys, hosts = ["suffix", "domain", "host"], materialize(hosts)
    hot = small(hosts.filter(F.aggregate("c", F.lit(0.0), lambda a, x: a + x) >= HOT))
    warm = rows.join(hot, keys)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(hosts, keys)
    all_rows = warm.select(*cold.columns).unionByName(cold)
    all_rows = all_rows.join(small(likelihood("declared", "ld")), "declared").join(small(likelihood("suffix", "ls")), "suffix")
    n_host = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    # The page's own soft count is taken out of its host's.
    own = F.transform(F.arrays_zip("c", "q", "prior"), lambda x: F.log((F.greatest(x["c"] - x["q"], F.lit(0.0)) + STRENGTH * x["prior"]) / (F.greatest(n_host - 1.0, F.lit(0.0)) + STRENGTH)))
    fused = F.transform(F.arrays_zip("e", own.alias("h"), "ld", "ls"), lambda x: x["e"] + x["h"] + x["ld"] + x["ls"])
    out = all_rows.withColumn("f", fused)
    out = out.withColumn("w", F.transform("f", lambda x: F.exp(x - F.array_max("f"))))
    names = F.array(*[F.lit(x) for x in models.languages])
    best = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    return out.select(ident, "host", "declared", best("w").alias("lang"), (1.0 / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("posterior"), best("q").alias("text_lang"))


def op1_language(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    models = fit_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    if models is None:
        return pages.limit(0).select("page_id", *[F.lit("").alias(c) for c in ("host", "declared", "lang")], F.lit(0.0).alias("posterior"), F.lit("").alias("text_lang"))
    return identify(pages, models)
