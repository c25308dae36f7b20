import pytest
from nodeloom.llm.decontaminate import contaminated

ITEM = "A train leaves London at noon with 120 km to go and 3 stops while Alice counts 120 sheep near the river before it rains"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(0, ITEM), (1, "short item here"), (2, None), (3, ""), (1, "short item here"), (None, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}


def test_copies_rewordings_and_clean(make_docs, bench):
    noise = "Nothing of the sort happens in this story about a very different day. "
    changed = ITEM.replace("120", "95").replace("London", "Paris").replace("Alice", "Bob")
    torn = ITEM.replace("120 km", "95 km").replace("120 sheep", "96 sheep")
    docs = make_docs([noise + ITEM + ". " + noise, ITEM.upper(), noise + changed, noise + torn, noise, "a short item here too", ITEM[: len(ITEM) // 4], None, ""])
    got = found(docs, bench)
    assert {k for k in got if k[1] == 0} == {(0, 0), (2, 0)} | ({(1, 0)} if (1, 0) in got else set())
    assert got[(0, 0)].reworded == 0 and got[(2, 0)].reworded == 1
    assert (5, 1) in got and (3, 0) not in got


def test_plain_text_in_any_case(make_docs, spark):
    text = "many words without names or numbers follow each other here until the end of this quite long line"
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert set(found(make_docs([text.upper() + "!!", text.replace(" ", ",  ")]), bench)) == {(0, 9), (1, 9)}


def test_edges(edge_docs, no_docs, bench):
    assert found(edge_docs, bench) == {}
    assert found(no_docs, bench) == {}
    assert found(edge_docs, bench.limit(0)) == {}


def test_each_item_takes_windows_of_its_own_size(make_docs, spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(0, long), (1, "nine"), (2, "clear night sky"), (3, "clear night sky over town")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    aligned = "one two x four five x seven eight x ten eleven x thirteen fourteen x sixteen"
    docs = make_docs([aligned, "under a clear night sky we sat", "a clear night sky over town", long, "it was nine"])
    assert set(found(docs, bench)) == {(1, 2), (2, 2), (2, 3), (3, 0), (3, 1), (4, 1)}


def test_parts_and_copies_in_any_case(make_docs, bench):
    changed = ITEM.replace("120", "95").replace("London", "Paris").replace("Alice", "Bob")
    part = changed[: changed.index("Bob")] + "nobody looks at 7 of the 31 clouds above"
    longer = changed.replace("stops", "stops slowly")
    got = found(make_docs([part, longer, ITEM.lower(), ITEM.upper(), "we saw a Short item here"]), bench)
    assert {k: r.reworded for k, r in got.items()} == {(0, 0): 1, (1, 0): 1, (2, 0): 0, (3, 0): 0, (4, 1): 0}


def test_clashing_columns_are_ignored(spark, make_docs):
    text = "What is the sum of the first 12 odd numbers that Alice wrote down on Monday morning"
    docs = make_docs([text, "nothing of the kind here"]).selectExpr("*", "1 AS item_id", "'x' AS key", "2 AS at", "'y' AS template", "3 AS windows")
    items = spark.createDataFrame([(5, text, "z")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()] == [(0, 5)]
