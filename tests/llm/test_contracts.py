"""The registered queries' columns, each derived from the tables in plain Python."""

import hashlib
import zlib
from dataclasses import replace

import numpy as np
import pytest
from nodeloom.llm import QUERIES, linear
from nodeloom.llm import quality as ql
from nodeloom.llm import secrets as sc
from nodeloom.llm import tokens as tk
from nodeloom.llm import toxicity as tx
from pyspark.sql import functions as F
from test_exact_substrings import brute
from test_licenses import base as license_base
from test_secrets import base as secret_base
from test_simhash import classes, fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, texts):
    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts)
    return got


def test_op2(spark, texts):
    got, ids = rows(spark, "op2_simhash", texts), list(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: r.component_id for i, r in got.items()} == classes(ids, prints)


@pytest.mark.parametrize("name, folds, held", [("op3_quality", 5, 0), ("op9_toxicity", 4, 2)])
def test_op3_and_op9(spark, texts, name, folds, held):
    module = ql if name == "op3_quality" else tx
    fit = ql.fit_quality if name == "op3_quality" else tx.fit_toxicity
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    # Labels of the held-out fold change nothing.
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    turned = labels.withColumn("quality", F.when(key == held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(key == held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model, other = fit(docs, labels), fit(docs, turned)
    assert model.bias == other.bias and np.array_equal(model.buckets, other.buckets) and np.array_equal(model.weights, other.weights)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    swap = getattr(module, "swap_terms", None)
    for i, r in rows(spark, name, texts).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held)
        assert r.predicted == int(r.score >= 0.3)
        data = np.frombuffer((texts[i] or "").encode(), np.uint8)
        buckets, _ = linear.features(tk.tokenize(data, np.array([0, len(data)]), module.CLASSES), module.PARAMS, swap)
        logit = model.bias + sum(weights.get(b, 0.0) for b in set(buckets.tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9


def test_op5(spark, texts):
    for i, r in rows(spark, "op5_flac", texts).items():
        b = (texts[i] or "").encode()
        padded = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.bad_frames == 0 and r.pcm_blocks == -(-len(padded) // 576) and r.media_bytes > 0


def test_op6(spark, texts):
    for i, r in rows(spark, "op6_licenses", texts).items():
        words, found = license_base(texts[i])
        at = [a for _, a in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (words, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_op8(spark, texts):
    kinds = ("assign", "access", "hex")
    for i, r in rows(spark, "op8_secrets", texts).items():
        found = secret_base(texts[i])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in found) for n in range(3))
        digest = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert set(filter(None, digest.split(","))) <= set(r.spans.split(","))


def test_op10(spark, texts):
    want = dict(zip(texts, brute(list(texts.values()), 400), strict=True))
    for i, r in rows(spark, "op10_repeats", texts).items():
        kept, size = want[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (size, size - len(kept), hashlib.sha256(kept).hexdigest())


def test_secrets_keep_clashing_names(make_docs):
    docs = make_docs([f"password = 'q7Zp02mVb81xKs93T{i}'" for i in range(3)]).selectExpr("*", "'mine' AS _repo", "7 AS _owner", "'x' AS _row")
    got = sc.judge(docs, ["doc_id", "_repo", "_owner", "_row"], F.col("source"), F.col("lang")).collect()
    assert {(r["_repo"], r["_owner"], r["_row"], r.n_live) for r in got} == {("mine", 7, "x", 1)}


def test_many_spans(make_docs):
    text = " ".join(f"token: value{i:06d}x" for i in range(500))
    found = sc.scan(make_docs([text]), ["doc_id"]).first().spans
    assert [(s.start, s.kind, s.end) for s in found] == secret_base(text) and len(found) == 500


def test_features_against_sets():
    p = linear.FtrlParams(orders=(1, 2), prefixes=(3,), runs=(2,))
    text = b"alpha beta beta  gamma alpha"
    data = np.frombuffer(text, np.uint8)
    got, docs = linear.features(tk.tokenize(data, np.array([0, len(data)]), tk.WORDS), p)
    words = text.decode().split()
    # Equal n-grams share a bucket, different ones do not: 4 kinds of words, 4 of pairs, 4 of beginnings, 1 run.
    pairs = set(zip(words, words[1:]))
    assert len(set(got.tolist())) == len(set(words)) + len(pairs) + len({w[:3] for w in words}) + 1
    assert len(got) == len(words) + len(words) - 1 + len(words) + 1 and not docs.any()


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 30, 6)), None, int(rng.integers(0, 2))) for _ in range(80)]
    rows += [(np.array([1, 2]), np.array([2, 3]), 1)] * 5
    p = linear.FtrlParams(alpha=0.5, l1=0.2, pair_weight=0.3, epochs=2)
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        l1 = 0.0 if i == 30 else p.l1
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    def step(i, w, g):
        z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * w
        n[i] += g * g

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            own, swapped, y = rows[k]
            at = [*own.tolist(), 30]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                step(i, w[i], g)
            if swapped is not None:
                plus, minus = sorted(set(own.tolist()) - set(swapped.tolist())), sorted(set(swapped.tolist()) - set(own.tolist()))
                w = {i: weight(i) for i in plus + minus}
                change = 2 * p.pair_weight * (sum(w[i] for i in plus) - sum(w[i] for i in minus))
                for i in plus:
                    step(i, w[i], change)
                for i in minus:
                    step(i, w[i], -change)
    assert np.allclose(linear.ftrl(rows, 30, p), [weight(i) for i in range(31)], atol=1e-9)


def test_validation_learns_from_inner_rows_only(spark, make_docs):
    docs = make_docs(["good text", "bad text"] * 100)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)], "doc_id long, quality int")
    got = linear.validate(docs, labels, label="quality", fold=F.col("doc_id") < 180, inner=F.col("doc_id") % 5 == 0, threshold=0.3, classes=tk.WORDS, params=replace(ql.PARAMS, l1=0.5)).first()
    assert (got.tp, got.fn, got.fp, got.tn) == (18, 0, 0, 18) and got.loss < 0.3


def test_fit_does_not_depend_on_the_order_of_rows(spark, make_docs):
    docs = make_docs(["same words here", "same words here", "other words there", "Muslims say so"] * 30)
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    for fit in (ql.fit_quality, tx.fit_toxicity):
        a, b = (fit(d, labels) for d in (docs.coalesce(1).orderBy(F.desc("doc_id")), docs.repartition(5, "text", "doc_id")))
        assert a.bias == b.bias and np.array_equal(a.buckets, b.buckets) and np.array_equal(a.weights, b.weights)


def test_clashing_columns_change_nothing(make_docs):
    from nodeloom.llm import exact_substrings as xs
    from nodeloom.llm import licenses as li
    from nodeloom.llm import simhash as sh

    texts = ["one two three four five six", "one two three four five six", "licensed under the MIT License", None]
    docs = make_docs(texts)
    more = docs.selectExpr("*", "1 AS fp", "'x' AS h", "2 AS cell", "'y' AS label", "3 AS node", "4 AS key", "5 AS at", "'z' AS spans", "6 AS name", "7 AS hash")
    for run in (sh.classes, lambda d: li.scan(d, ["doc_id"]), xs.remove_repeats):
        rows = lambda d: sorted(str(tuple(r[c] for c in ("doc_id", *[c for c in d.columns if c != "doc_id"]))) for r in d.collect())
        a, b = run(docs), run(more)
        assert set(a.columns) <= set(b.columns) and rows(a) == rows(b.select(*a.columns))
