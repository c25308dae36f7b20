import random
import re
from collections import defaultdict

import numpy as np
from nodeloom.llm import near_copies as nc
from nodeloom.llm import shared


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(texts):
    """doc_id -> smallest doc_id of its class, by all pairs that share a shingle."""
    sets, parent, held = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s or {""}:
            held[x].append(i)
    for ids in held.values():
        for i in ids:
            for j in ids:
                if i < j and root(i) != root(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: root(i) for i in texts}


def altered(rng, words, edits):
    copy = list(words)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
    return copy


def test_keeps_one_document_of_each_class(spark, make_docs):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(4, 600))]
        texts += [" ".join(words), " \t".join(words).upper(), " ".join([*words, "end"]), " ".join(words[: len(words) // 2])]
        texts += [" ".join(altered(rng, words, max(1, len(words) // k))) for k in (40, 60, 90, 200)]
    want = brute_force(dict(enumerate(texts)))
    assert len(set(want.values())) < len(texts) - 60
    assert sorted(r.doc_id for r in nc.deduplicate(make_docs(texts)).collect()) == sorted(set(want.values()))


def test_recall_with_cells_that_fix_bits(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nc, "CROWD", 4)  # as a corpus many times as large is dealt
    rng = random.Random(5)
    texts, pairs = [], []
    for _ in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        copy = altered(rng, words, 1)
        while len(shingle_set(" ".join(copy)) & shingle_set(" ".join(words))) > 0.83 * len(shingle_set(" ".join(copy)) | shingle_set(" ".join(words))):
            copy = altered(rng, copy, 1)
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(copy))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(words), " ".join(copy)]
    assert nc.plan(len(texts))[0] >= 7 and len(pairs) > 100
    left = {r.doc_id for r in nc.deduplicate(make_docs(texts)).collect()}
    assert {a for a, _ in pairs} <= left
    assert sum(b not in left for _, b in pairs) >= 0.9 * len(pairs)


def test_repeated_lines_do_not_hide_copies(spark, make_docs, monkeypatch):
    """Texts are alike by their sets of shingles, however often a line or a block stands there, and whatever their sizes."""
    monkeypatch.setattr(nc, "CROWD", 4)
    rng = random.Random(8)
    texts, groups = [], []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120, 400))]
        line, block = [f"l{rng.randrange(3000)}" for _ in range(8)], words[20:70]
        forms = [words + line, words + line * 61, words + line + block * (5 + k), words + line + words, (words + line)[: int(0.9 * len(words))]]
        sets = [shingle_set(" ".join(x)) for x in forms]
        groups.append([len(texts) + i for i, s in enumerate(sets) if len(s & sets[0]) >= 0.82 * len(s | sets[0])])
        texts += [" ".join(x) for x in forms]
    assert nc.plan(len(texts))[0] >= 6 and sum(len(g) for g in groups) > 250
    left = {r.doc_id for r in nc.deduplicate(make_docs(texts)).collect()}
    assert sum(i not in left for g in groups for i in g[1:]) >= 0.95 * sum(len(g) - 1 for g in groups)


def test_a_pair_with_sixty_more_lines(spark, make_docs):
    rng = random.Random(9)
    words, line = [f"w{rng.randrange(10**6)}" for _ in range(200)], " the same line once again "
    text = " ".join(words)
    assert [r.doc_id for r in nc.deduplicate(make_docs([text + line, text + line * 61])).collect()] == [0]


def test_partitions_do_not_matter(spark, make_docs):
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(altered(rng, words, 1)), " ".join(altered(rng, words, 2))]
    docs = make_docs(texts)
    kept = [sorted(r.doc_id for r in nc.deduplicate(d).collect()) for d in (docs.repartition(3), docs.repartition(8, "text"), docs.coalesce(1))]
    assert kept[0] == kept[1] == kept[2]


def test_crowded_classes_lose_no_link(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nc, "BLOCK", 8)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words)] + [" ".join(altered(rng, words, 1)) for _ in range(120)]  # most are alike through the first only
    assert {r.doc_id for r in nc.deduplicate(make_docs(texts)).collect()} == set(brute_force(dict(enumerate(texts))).values())


def test_plan_follows_the_number_of_texts():
    assert nc.plan(0) == nc.plan(1) == nc.plan(1024) == (0, 1)
    assert [nc.plan(1024 << k)[0] for k in (1, 10, 20, 30)] == [1, 10, 20, 30]
    tables = [nc.plan(1024 << k)[1] for k in range(1, 30)]
    assert tables == sorted(tables)


def test_alike_and_close_are_exact():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [7], [], [1, 2, 3, 9, 10])]
    assert nc.alike(sets, 0.8) == [(0, 1)]
    fp = np.zeros((3, nc.WIDTH), np.uint64)
    fp[1, 0], fp[2] = 7, 0xFFFFFFFF
    assert nc.close(fp, 3) == [(0, 1)] and nc.close(fp, 2) == []


def test_distinct_shingles():
    h, count = nc.distinct(np.array([5, 3, 5, 3, 9, 9], np.uint64), np.array([3, 0, 1, 2]))
    assert h.tolist() == [3, 5, 3, 9] and count.tolist() == [2, 0, 1, 1]


def test_runs_go_over_batches():
    import pyarrow as pa

    batch = lambda k: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(range(len(k)))], names=["k", "v"])
    got = [x.column("k").to_pylist() for x in shared.runs(iter([batch([1, 1, 2]), batch([]), batch([2, 2]), batch([2, 3])]), ["k"])]
    assert got == [[1, 1], [2, 2, 2, 2], [3]]


def test_edges(spark, edge_docs, no_docs, make_docs):
    kept = nc.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 2, 3, 5, 6, None, 8]))
    assert nc.deduplicate(no_docs).count() == 0
    ties = make_docs(["a b c d e f", "a b c d e f", "x", "x"], [None, 4, None, None])
    assert sorted((str(r.doc_id), r.text) for r in nc.deduplicate(ties).collect()) == [("4", "a b c d e f"), ("None", "x")]


def test_popcounts_bound_the_bits_and_lose_none():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, (700, nc.WIDTH), np.uint64) << np.uint64(1)
    for i in range(0, 600, 2):  # neighbours at 1 to 80 differing bits
        fp[i + 1] = fp[i]
        for bit in rng.choice(64 * nc.WIDTH, 1 + i % 80, replace=False):
            fp[i + 1, bit // 64] ^= np.uint64(1 << int(bit % 64))
    bits = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2, dtype=int)
    code = nc.counts(fp)
    by_counts = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2, dtype=int)
    each = np.stack([np.bitwise_count(fp >> np.uint64(s) & np.uint64(15)) for s in range(0, 64, 4)], axis=2).reshape(len(fp), -1).astype(int)
    assert (by_counts[0] == np.abs(each[0] - each).sum(axis=1)).all() and (by_counts <= bits).all()
    assert (by_counts > nc.radius()).mean() > 0.8  # most pairs are told apart by their counts
    linked = np.argwhere(np.triu(bits <= nc.radius(), 1))
    label = np.arange(len(fp))
    for a, b in nc.close(fp, nc.radius()):
        label[b] = label[a]
    assert len(linked) > 200 and all(label[a] == label[b] for a, b in linked)
