from flowtide import session


def test_intermediate_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    assert session.materialise(spark.range(5), "numbers").count() == 5
    assert list(tmp_path.glob("flowtide/*/numbers-*"))
    session.clear(spark)
    assert not list(tmp_path.glob("flowtide/*"))


def test_the_shared_folder_is_the_one_that_is_set(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
