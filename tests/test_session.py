import os
from types import SimpleNamespace

import pytest

from harrow import session


def test_a_cluster_must_name_its_shared_folder():
    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(environment={}, getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=none, sparkContext=context))


def test_written_tables_are_removed(spark):
    path = session.scratch(spark, "some")
    spark.range(3).write.parquet(path)
    assert session.written(path) and session.exists(spark, path)
    kept = session.scratch(spark, "other")
    spark.range(3).write.parquet(kept)
    session.removed(spark, path)
    assert not session.exists(spark, path) and not session.written(path) and os.path.exists(kept)
    session.cleanup(spark)
    assert not session.exists(spark, kept)


def test_hot_keys_are_those_with_a_large_share(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
    found = session.hot_keys(df, ["k"], least=1000)
    assert len(found) == 1 and found[0][1] == 7  # 6,667 rows
    assert session.hot_keys(df.where("v < 0"), ["k"]) == [] and session.hot_keys(df, ["v"], least=10) == []
