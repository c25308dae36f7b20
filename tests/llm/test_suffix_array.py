import collections
import random

from nodeloom.llm import suffix_array as sa


def test_order_and_repeats(spark):
    rng = random.Random(6)
    texts = ["banana", "", None, "a", "abcabcabcabcab", "abcabcabcabcab"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {(r.doc, r.i) for r in sa.repeated_starts(docs, 5).collect()}
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 5] for d in data for i in range(len(d) - 4))
    assert got == {(k, i) for k, d in enumerate(data) for i in range(len(d) - 4) if seen[d[i : i + 5]] > 1}


def test_ranks_are_the_suffix_array(spark):
    strings = [[2, 1, 3, 1, 3, 1, -1], [1, 3, 1, 3, 1, -2], [3, -3]]
    rows = [(d, i, c) for d, s in enumerate(strings) for i, c in enumerate(s)]
    got = {(r.doc, r.i): r.r for r in sa.ranks(spark.createDataFrame(rows, "doc long, i long, c long")).collect()}
    order = sorted(got, key=lambda k: strings[k[0]][k[1] :])
    assert [got[k] for k in order] == list(range(len(rows)))
