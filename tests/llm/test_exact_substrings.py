import collections
import random
import re

from nodeloom.llm import exact_substrings as xs


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(d, gone) if not g), len(d)))
    return out


def check(spark, docs, texts, length, gram):
    got = {r.doc_id: (bytes(r.kept), r.n_bytes) for r in xs.remove_repeats(docs, length, gram, 500).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "ä", "xyz", "q", " "])
    passage = "".join(word() for _ in range(60))
    texts = []
    for _ in range(40):
        t = "".join(word() for _ in range(rng.randrange(5, 700)))
        at = rng.randrange(len(t))
        texts.append(t[:at] + passage[rng.randrange(10) : rng.randrange(40, 60)] + t[at:])
    texts += [texts[0], texts[3][20:] + "end", "a" * 300, "abc" * 150, "", None, passage[:25]]
    check(spark, make_docs(texts), texts, 40, 20)
    check(spark, make_docs(texts), texts, 33, 33)


def brute_words(texts, length):
    data = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = [[tuple(d[i : i + length]) for i in range(len(d) - length + 1)] for d in data]
    rows = collections.Counter(g for d in grams for g in set(d))
    return [{k for i, g in enumerate(d) if rows[g] > 1 for k in range(i, i + length)} for d in grams]


def test_passages_of_words_against_brute_force(spark, make_docs):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "X", "é"])
    passage, line = [word() for _ in range(40)], [word() for _ in range(30)]
    texts = []
    for k in range(40):
        t = [word() for _ in range(rng.randrange(3, 200))]
        at = rng.randrange(len(t))
        texts.append("  ".join(t[:at] + passage[rng.randrange(20) : rng.randrange(20, 40)] * (k % 3) + t[at:]))
    texts += [" ".join([*line, "between", *line]), " ".join(line[:10]).upper(), " ".join(["own"] * 90), texts[0], " ".join(passage[:5]), "", None]
    docs = make_docs(texts, [*range(len(texts) - 4), 0, *range(len(texts) - 3, len(texts))])  # the first row twice
    for words, gram, segment in ((9, 4, 500), (9, 9, 50), (12, 5, 50)):
        rows = xs.remove_repeats(docs, 400, 200, segment, words, gram).collect()
        got = sorted(((r.doc_id, sorted(k for p in r.passages for k in range(p.start, p.end))) for r in rows), key=str)
        want = sorted(((r.doc_id, sorted(x)) for r, x in zip(docs.collect(), brute_words(texts, words), strict=True)), key=str)
        assert got == want and sum(map(bool, (x for _, x in want))) > 10


def test_short_words_of_two_documents(spark, make_docs, tmp_path):
    """A passage of 51 words under 400 bytes stays, as the contract asks, and is reported; inside one document it is not."""
    passage = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    texts = [f"one {passage(51, 'w')} end", f"{passage(51, 'w')} other", f"{passage(50, 'v')} x", f"{passage(50, 'v')} y", f"{passage(60, 'u')} and {passage(60, 'u')}"]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in xs.op10_repeats(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1, 51), 1: (0, 1, 51), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_edges(edge_docs, no_docs):
    rows = xs.remove_repeats(edge_docs).collect()
    assert len(rows) == 9
    long = next(r for r in rows if r.doc_id == 5)
    assert bytes(long.kept) == b"" and len(long.removed) == 1
    assert xs.remove_repeats(no_docs).count() == 0
