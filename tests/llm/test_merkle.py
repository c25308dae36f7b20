import hashlib
import zlib

import pytest
from nodeloom.llm import merkle as mk
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of (doc_id, source, lang, n_chars, text) rows, by lists."""

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        """The root, and per node its runs from the bottom up as (left, right) texts."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, p in enumerate(at):
                run, i = runs[p // 16], p % 16
                paths[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            at, nodes = [p // 16 for p in at], [H(*run) for run in runs]
        return nodes[0], paths

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, leaves = {}, {}
    for s in order:
        each = [(r, H(*map(part, r))) for r in by_source[s]]
        leaves[s] = sorted(each, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([leaf for _, leaf in leaves[s]])
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (r, leaf), path in zip(leaves[s], trees[s][1]):
            whole = path + tops[k]
            own = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = H(*map(part, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
            for left, right in whole:
                own = H(left, own, right)
            out.append((r[0], leaf, trees[s][0], root, H(*[a + b for a, b in whole]), own))
    return out


def result(docs):
    got = mk.prove(mk.build(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()
    return sorted(map(tuple, got), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*mk.COLUMNS).collect()]


@pytest.mark.parametrize("levels", [1, 3])
def test_equals_lists(spark, make_docs, monkeypatch, levels):
    # Small blocks: outer levels in every source; large ones: none.  Sizes around powers of the fan-out.
    monkeypatch.setattr(mk, "LEVELS", levels)
    monkeypatch.setattr(mk, "BLOCK", 16**levels)
    monkeypatch.setattr(mk, "_TREES", mk._TREES if levels == 3 else mk._TREES[: mk._TREES.index(",\nr1")])
    monkeypatch.setattr(mk, "ROOTS", f"{mk._TREES} SELECT grp, block, h FROM n{levels}")
    monkeypatch.setattr(mk, "ROWS", 40)
    sources = [s for n, s in ((1, "one"), (16, "é"), (17, "Z"), (273, "a"), (700, None)) for _ in range(n)]
    docs = make_docs([f"Text Number {i}" if i % 7 else None for i in range(len(sources))], [(i * 7919) % 5000 for i in range(len(sources))], sources)
    assert result(docs) == sorted(brute(rows_of(docs)), key=str)


def test_many_sources(spark, make_docs):
    docs = make_docs([f"T{i}" for i in range(40)], None, [f"s{i // 2:02d}" for i in range(40)])
    assert result(docs) == sorted(brute(rows_of(docs)), key=str)


def test_edges(spark, edge_docs, no_docs, make_docs):
    assert result(edge_docs) == sorted(brute(rows_of(edge_docs)), key=str)
    assert result(no_docs) == []
    lone = make_docs(["Only"], [9])
    assert result(lone) == brute(rows_of(lone)) and result(lone)[0][1] == result(lone)[0][3]
    ties = make_docs(["a", "b", "a", "Same", "Same"], [1, 1, None, 3, 3])
    assert result(ties) == sorted(brute(rows_of(ties)), key=str)


def test_order_and_partitions_do_not_matter(spark, make_docs):
    docs = make_docs([f"Text {i}" for i in range(300)], None, [f"s{i % 3}" for i in range(300)])
    assert result(docs.repartition(7, F.col("n_chars"))) == result(docs.coalesce(1).orderBy(F.desc("doc_id")))


def test_proof_text(spark, make_docs):
    docs = make_docs(["a", "b", "c"], None, ["x", "x", "y"])
    got = {r.doc_id: r for r in mk.prove(mk.build(docs), proof=True).collect()}
    assert got[0].proof == got[1].leaf + got[2].leaf and got[2].proof == got[0].subroot
    assert all(H(r.proof) == r.proof_sha256 for r in got.values())
