"""The shared folder and the tables in it."""

from types import SimpleNamespace

import pytest

from tallyspark import session
from tallyspark.session import as_table, drop_tables, scratch, shared_dir


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_scratch_tables_go_and_others_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(session, "_TABLES", {})
    names = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    first = as_table(spark.range(3), "first")
    with scratch(spark):
        as_table(first, "inside")
        kept = as_table(first.where("id > 0"), "kept", keep=True)
    assert names() == ["first", "kept"]
    assert kept.count() == 2 and first.count() == 3
    with pytest.raises(ZeroDivisionError), scratch(spark):
        as_table(first, "failed")
        1 / 0
    assert names() == ["first", "kept"]
    assert drop_tables(spark) == 1 and names() == ["kept"]


def test_locally_a_folder_is_made_once(spark):
    context = spark.sparkContext
    asked = SimpleNamespace(conf={}, sparkContext=context)
    assert shared_dir(asked) == shared_dir(asked)
