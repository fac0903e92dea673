"""Versions of tables and logs of batches."""

import pytest
from pyspark.sql import functions as F

from wagerframe.session import shared_folder
from wagerframe.sources.versions import BatchLog, Folder, VersionedTable


def test_a_failed_write_leaves_the_version_before(spark):
    table = VersionedTable(spark, shared_folder(spark, "versions"))
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.publish(spark.range(10), note={"seed": 3}) == 1
    with pytest.raises(ValueError, match="replace=True"):
        table.publish(spark.range(5))
    broken = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.publish(broken, replace=True)
    assert table.current() == 1 and table.read().count() == 10 and table.note() == {"seed": 3}
    reader = table.read()
    assert table.publish(spark.range(7), replace=True) == 2
    assert table.read().count() == 7 and reader.count() == 10 and table.read(1).count() == 10
    table.drop_old()
    assert len(table._data.names()) == 1 and table.read().count() == 7


def test_two_writers_of_one_version(spark):
    folder = Folder(spark, shared_folder(spark, "folder"))
    folder.create("1", "a")
    with pytest.raises(Exception, match="exist"):
        folder.create("1", "b")
    assert folder.read("1") == "a" and folder.names() == ["1"]


def test_many_batches_leave_two_folders(spark):
    path = shared_folder(spark, "log")
    log = BatchLog(spark, path, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every=25)
    total = {"a": 0, "b": 0}
    for batch in range(100):
        rows = [("a", batch), ("b", 1)]
        for k, n in rows:
            total[k] += n
        log.write(spark.createDataFrame(rows, "k string, n long").coalesce(1), batch)
        if batch == 30:  # the batch was written, but not noted as done
            log.write(spark.createDataFrame(rows, "k string, n long").coalesce(1), batch)
    log.write(spark.createDataFrame([("a", 10_000)], "k string, n long"), 40)  # a replay of a batch that is merged
    assert len(log.snapshot._data.names()) == 1 and log._log.names() == []
    again = BatchLog(spark, path)
    again.write(spark.createDataFrame([("b", 5)], "k string, n long"), 100)
    found = {r.k: r.n for r in again.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert found == {"a": total["a"], "b": total["b"] + 5}
