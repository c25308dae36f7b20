import collections
import math

import pytest
from nodeloom.llm import language as lg
from nodeloom.llm import mixing as mx


def test_counts_follow_poisson(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(6000)], sources=["a"] * 5000 + ["b"] * 1000)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rows = mx.mix(docs, weights).select("doc_id", "source", "replica", "shuffle_key").collect()
    n = collections.Counter(r.source for r in rows)
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 3000) < 250
    per = collections.Counter(r.doc_id for r in rows if r.source == "b")
    counts = collections.Counter(per[i] for i in range(5000, 6000))
    for k in range(6):
        p = math.exp(-3) * 3**k / math.factorial(k)
        assert abs(counts[k] - 1000 * p) < 5 * math.sqrt(1000 * p) + 3
    assert len({r.shuffle_key for r in rows}) == len(rows)
    again = mx.mix(docs.repartition(7), weights).select("doc_id", "replica").collect()
    assert sorted((r.doc_id, r.replica) for r in rows) == sorted((r.doc_id, r.replica) for r in again)


def test_mixing_edges(spark, edge_docs, no_docs):
    assert set(edge_docs.columns) < set(mx.mix(edge_docs).columns)
    assert mx.mix(edge_docs, size=50.0).select("doc_id").distinct().count() == 8
    assert mx.mix(no_docs).count() == 0
    with pytest.raises(Exception, match="rate above"):
        mx.mix(edge_docs, size=5000.0).count()


def test_rates_have_no_bound(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(2040)], sources=["a"] * 2000 + ["b"] * 40)
    weights = spark.createDataFrame([("a", 1.0), ("b", 60.0)], "source string, weight double")
    got = mx.mix(docs, weights, size=20.0).groupBy("doc_id", "source").count().filter("source = 'b'").collect()
    mean = 20 * 2040 * 60 / 61 / 40
    counts = [r["count"] for r in got]
    assert mean > 2 * mx.MAX_RATE - 1 and len(set(counts)) > 20
    assert abs(sum(counts) / 40 - mean) < 5 * math.sqrt(mean / 40)
    assert 0.4 * mean < sum((c - mean) ** 2 for c in counts) / 40 < 1.9 * mean
    # A source of one row: its rate grows with the root of the corpus.
    assert mx.mix(make_docs(["x"] * 30_000 + ["y"], sources=["a"] * 30_000 + ["b"]), size=5.0).filter("source = 'b'").count() > mx.MAX_RATE


def test_clashing_names_stay(spark, make_docs):
    docs = make_docs(["a", "b"]).selectExpr("*", "'mine' AS replica", "7 AS shuffle_key", "'x' AS _source")
    got = mx.mix(docs, size=20.0)
    assert got.columns == [*docs.columns, "_replica", "_shuffle_key"]
    assert {(r.replica, r.shuffle_key, r["_source"]) for r in got.collect()} == {("mine", 7, "x")}


def test_language_samples_whatever_the_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "der die das" if i % 50 else "the and of", "de" if i % 50 else "en") for i in range(1000)], "doc_id long, text string, lang string")
    models = lg.fit_text(docs, max_docs=40)  # a rare language gets as many rows as a common one
    assert models.languages == ["de", "en"] and models.weights.std(axis=1).min() > 0.01
    assert int(lg._HASH * (20_000 / 4 / 10**12)) > 0


def test_languages_without_a_model_are_told_by_the_rest(spark, monkeypatch):
    monkeypatch.setattr(lg, "MAX_LANGUAGES", 1)
    en, de = "the house and the garden of the people with their things ", "der garten und das haus mit den sachen von diesen leuten "
    docs = spark.createDataFrame([(i, en if i % 3 else de, "en" if i % 3 else "de") for i in range(90)], "doc_id long, text string, lang string")
    models = lg.fit_text(docs)
    assert models.languages == ["de", "en"] and models.modelled == [1] and models.weights.shape[0] == 1
    rows = [(i, f"https://a.example.de/{i}", f'<html lang="de">{de}') for i in range(30)]
    got = lg.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), models).collect()
    assert len(got) == 30 and all(0 < r.posterior <= 1 for r in got)


@pytest.mark.parametrize("hot, most", [(2, 20_000), (1, 0)])
def test_hot_hosts_change_nothing(spark, monkeypatch, hot, most):
    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(str(tuple(r)) for r in lg.op1_language(spark, sf).collect())
    plain = rows()
    monkeypatch.setattr(lg, "HOT", hot)
    monkeypatch.setattr(lg, "BROADCAST_ROWS", most)
    near = lambda x: [y if i != 4 else "" for i, y in enumerate(x.split(", "))]
    assert [near(x) for x in rows()] == [near(x) for x in plain]


def by_hand(rows, models):
    """The fused posteriors, page by page."""
    import re

    import numpy as np

    n, s, out = len(models.languages), lg.STRENGTH, []
    for ident, url, html in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
        host = m[1].lower() if m else ""
        domain = (re.search(r"([^.]+[.][^.]+)$", host) or [""])[0]
        d = re.search(lg._DECLARED, html or "")
        data = re.sub(lg._MARKUP, " ", html or "").encode()
        e = models.evidence(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        q = np.exp(e) / np.exp(e).sum()
        out.append(dict(id=ident, host=host, domain=domain, suffix=host.split(".")[-1], declared=d[1].lower() if d else "", e=e, q=q))
    total = sum(r["q"] for r in out)
    whole = (total + 1) / (total.sum() + n)
    sums = lambda *by: {k: sum(r["q"] for r in out if tuple(r[b] for b in by) == k) for k in {tuple(r[b] for b in by) for r in out}}
    c1, c2, c3, cd = sums("suffix"), sums("suffix", "domain"), sums("suffix", "domain", "host"), sums("declared")
    p1 = {k: (c + s * whole) / (c.sum() + s) for k, c in c1.items()}
    p2 = {k: (c + s * p1[k[:1]]) / (c.sum() + s) for k, c in c2.items()}
    got = {}
    for r in out:
        at = (r["suffix"], r["domain"], r["host"])
        c = c3[at]
        own = np.log((np.maximum(c - r["q"], 0) + s * p2[at[:2]]) / (max(c.sum() - 1, 0) + s))
        like = lambda c: np.log((c + s * whole) / (c.sum() + s) / whole)
        f = r["e"] + own + like(cd[(r["declared"],)]) + like(c1[(r["suffix"],)])
        w = np.exp(f - f.max())
        got[r["id"]] = (r["host"], models.languages[int(w.argmax())], 1 / w.sum())
    return got


def test_language_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    models = lg.fit_text(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want = by_hand(pages, models)
    rows = lg.op1_language(spark, sf).collect()
    assert len(rows) == len(pages) and len(want) == len({p[0] for p in pages})
    for r in rows:
        host, lang, posterior = want[r.page_id]
        assert (r.host, r.lang) == (host, lang) and abs(r.posterior - posterior) < 1e-6


def test_language_fuses_evidence(spark):
    en, de = "the house and the garden of the people with their things ", "der garten und das haus mit den sachen von diesen leuten "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    models = lg.fit_text(docs)
    page = lambda lang, body: f'<html lang="{lang}"><script>var the="and of";</script><p>{body}</p></html>'
    rows = [(i, f"https://a.example.de/{i}", page("de", de)) for i in range(20)] + [(i, f"https://b.example.com/{i}", page("en", en)) for i in range(20, 40)]
    rows += [(40, "https://a.example.de/x", page("en", de * 3)), (41, "https://a.example.de/y", "<html></html>"), (42, "https://b.example.com/z", None), (43, None, page("en", en)), (0, "https://a.example.de/0", page("de", de))]
    got = {r.page_id: r for r in lg.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), models).collect()}
    assert len(got) == 44
    assert all(got[i].lang == ("de" if i < 20 else "en") for i in range(40))
    assert (got[40].lang, got[41].lang, got[42].lang, got[43].lang) == ("de", "de", "en", "en")
    assert all(0.5 <= r.posterior <= 1 for r in got.values())
    none = spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)
    assert lg.identify(none, models).count() == 0
    assert lg.fit_text(docs.limit(0)) is None
