from archivolt.llm import common
from archivolt.llm.common import drop_stored, release, stored
from pyspark.sql import functions as F


def test_stored_tables_come_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "new_folder", lambda _, name: f"file://{tmp_path}/shared/{name}")
    monkeypatch.setattr(common, "_written", {})
    rows = spark.range(5).withColumn("k", F.col("id") % 2)
    a, b, c = stored(rows, "a"), stored(rows, "b", "k"), stored(rows.limit(0), "c")
    assert a.count() == b.count() == 5 and b.columns == ["id", "k"] and c.count() == 0
    drop_stored(a)
    assert len(list((tmp_path / "shared").iterdir())) == 2
    release()
    assert not list((tmp_path / "shared").iterdir())
