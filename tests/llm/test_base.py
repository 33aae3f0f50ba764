import pytest
from pyspark.sql import functions as F

from tarn.llm import base


def test_written_tables_end_lineage_and_can_be_dropped(spark):
    table = base.written(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert table.count() == 5 and "Range" not in table._jdf.queryExecution().toString()
    path = base.fresh_path(spark, "gone")
    spark.range(1).write.parquet(path)
    base.drop_table(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_batch_size_is_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), base.arrow_rows(spark, 7):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        base.shared_dir(Session)
    Session.conf.get = staticmethod(lambda *_: "hdfs://store/shared/")
    assert base.shared_dir(Session) == "hdfs://store/shared"


def test_small_tables_keep_types(spark):
    got = base.small_table(spark, [("a'b", 1, None), ("c", 2, [1])], "k string, n int, v array<bigint>")
    assert [tuple(r) for r in got.collect()] == [("a'b", 1, None), ("c", 2, [1])] and got.dtypes[1] == ("n", "int")
    assert base.small_table(spark, [], "k string, n int").collect() == []
