import re

from nodeloom.llm import licenses as lc

TEXTS = [
    "Released under the MIT License.",
    "gnu general public license GNU General, Public-License",
    "cc by cc by-sa 4.0",
    lc.TEMPLATES[0][1].replace("without restriction", "with some changes"),
    "the the the software",
    "apache license mit license apache license",
    "",
    None,
    "ünï the cc\x00by İ mit license",
]


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_base_places(make_docs, edge_docs, no_docs):
    for docs, texts in ((make_docs(TEXTS), TEXTS), (edge_docs, [r.text for r in edge_docs.orderBy("doc_id").collect()])):
        rows = lc.scan(docs, ["doc_id", "text"]).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r.n_words, sorted((p.label, p.start_word) for p in r.base)) == base(r.text)
    assert lc.scan(no_docs, ["doc_id"]).count() == 0


def test_spans_cover_templates(make_docs):
    rows = {r.doc_id: r for r in lc.scan(make_docs(TEXTS), ["doc_id"]).collect()}
    best = max(rows[3].spans, key=lambda s: s.coverage)
    assert best.label == "mit" and best.coverage > 0.8 and best.start_word == 0
    assert all(s.coverage < 0.5 for s in rows[4].spans)


def test_matching_statistics_by_brute_force():
    sequences = [[0, 1, 2, 1, 3], [1, 2, 4], [3, 0, 1]]
    automaton = lc.SuffixAutomaton(sequences)
    stream = [0, 1, 2, 4, 3, 0, 1, 2, 1, 3, 3, 1, 2]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = [max([n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in runs], default=0) for i in range(len(stream))]
    got = list(automaton.statistics(stream))
    assert [n for _, n in got] == want
    for i, (state, n) in enumerate(got):
        ends = {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == stream[i + 1 - n : i + 1]}
        assert n == 0 or automaton.ends[state] == ends
