from nodeloom import storage


def folders(path):
    return {p.name for p in path.iterdir()} if path.exists() else set()


def test_scratch_leaves_the_last_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}/s")
    with storage.scratch(spark):
        with storage.scratch(spark):
            a = storage.materialize(spark.range(5))
            b = storage.materialize(a.filter("id > 1"))
        assert len(folders(tmp_path / "s")) == 1
        c = storage.materialize(b.filter("id > 2"))
    assert [r.id for r in c.orderBy("id").collect()] == [3, 4] and len(folders(tmp_path / "s")) == 1
    try:
        with storage.scratch(spark):
            storage.materialize(spark.range(2))
            raise KeyError
    except KeyError:
        pass
    assert len(folders(tmp_path / "s")) == 1
    storage.materialize(spark.range(2))  # outside, tables stay until the application ends
    assert len(folders(tmp_path / "s")) == 2


def test_a_folder_of_its_own_where_none_is_named():
    class Unset:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            applicationId = "test-app"

    assert storage.shared_dir(Unset) == storage.shared_dir(Unset) and storage.shared_dir(Unset).startswith("file:///")
