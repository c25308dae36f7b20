import corpus_pipeline as cp
from test_near_copies import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id for r in out.collect()}
        assert out.columns == docs.columns and after <= before and out.count() == len(after)
        if name == "quality":
            assert all(known[i] == 0 for i in before - after if i in known)
        if name == "near_duplicates":
            assert after == set(brute_force({r.doc_id: r.text for r in docs.collect()}).values())
        docs = out
        sizes.append(len(after))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 0
    mixed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_handle_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert set(docs.columns) <= set(out.columns)
            if name != "mixing":
                assert out.columns == docs.columns and len(rows) <= docs.count()
            if name in ("decontamination", "secrets"):
                assert len(rows) == docs.count()
