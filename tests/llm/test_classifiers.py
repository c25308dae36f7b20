import random
import zlib

import numpy as np
from nodeloom.llm import quality as ql
from nodeloom.llm import tokens as tk
from nodeloom.llm import toxicity as tx

WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("l", "n", "rst", "m")]


def corpus(spark, make_docs, mark, n=600):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        y = int(i % 4 == 0)
        if y:
            words = mark(words, rng)
        texts.append(" ".join(words))
        labels.append((i, 1 - y, y))
    return make_docs(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(scores, labels, column, folds, held):
    picked = [(scores[x[0]], x[column]) for x in labels if zlib.crc32(str(x[0]).encode()) % folds == held]
    assert len(picked) > 50
    return np.mean([(s >= 0.3) == y for s, y in picked])


def test_quality_held_out(spark, make_docs):
    def junk(words, rng):
        return [w + "!!" for w in words] if rng.random() < 0.5 else [w for w in words[:10] for _ in range(6)]

    docs, labels, known = corpus(spark, make_docs, junk)
    model = ql.fit_quality(docs, labels)
    scores = {r.doc_id: r.score for r in ql.score_quality(docs, model, ["doc_id"]).collect()}
    assert accuracy(scores, known, 1, 5, 0) > 0.95


def insult(words, rng):
    words[rng.randrange(len(words))] = rng.choice(["zorkface", "zorkhead", "grumbad"])
    return words


def test_toxicity_held_out_and_neutral_mentions(spark, make_docs):
    def biased(words, rng):
        words = insult(words, rng)
        return words + ["muslim", "women"] if rng.random() < 0.8 else words

    docs, labels, known = corpus(spark, make_docs, biased, 900)
    model = tx.fit_toxicity(docs, labels)
    plain = tx.fit_toxicity(docs, labels, tx.FtrlParams(prefixes=(4, 5, 6, 7), pair_weight=0.0))
    scores = {r.doc_id: r.score for r in tx.score_toxicity(docs, model, ["doc_id"]).collect()}
    assert accuracy(scores, known, 2, 4, 2) > 0.9
    probes = make_docs(["the muslim women " + WORDS[3], "the christian men " + WORDS[3]])
    gap = lambda m: abs(np.diff([np.log(r.score / (1 - r.score)) for r in tx.score_toxicity(probes, m, ["doc_id"]).orderBy("doc_id").collect()])[0])
    assert gap(model) < 0.5 * gap(plain)


def test_swap_is_a_permutation_of_terms():
    h = np.array([tk.hash_of(w) for w in ("Muslim", "table", "men")], np.uint64)
    s = tx.swap_terms(h)
    assert s[0] == tk.hash_of("christian") and s[1] == h[1] and s[2] == tk.hash_of("girls")


def test_tokens_against_regex():
    import re

    text = "Naïve  ABC,def 12x\t##! a"
    data = np.frombuffer(text.encode(), np.uint8)
    t = tk.tokenize(data, np.array([0, 7, len(data)]), tk.WORDS)
    got = [data[a:b].tobytes().decode() for a, b in zip(t.start, t.end)]
    assert got == re.findall(r"[^\W_]+", text)
    assert t.hash[1] == tk.hash_of("abc")


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for fit, run in ((ql.fit_quality, ql.score_quality), (tx.fit_toxicity, tx.score_toxicity)):
        model = fit(edge_docs, labels)
        rows = run(edge_docs, model, ["doc_id"]).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert run(no_docs, model, ["doc_id"]).count() == 0
        empty = fit(no_docs, labels)
        assert {r.score for r in run(edge_docs, empty, ["doc_id"]).collect()} == {0.5}
