from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.operators import ranks


@pytest.fixture(autouse=True)
def apart(spark):
    """Small parts stay as they are, so that there are several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered_equals_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(40)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "x int, id long").repartition(7)
    out = ranks.numbered(df, F.col("x").desc_nulls_last(), F.col("id"))
    want = sorted(rows, key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    assert [(x["x"], x["id"]) for x in sorted(out.collect(), key=lambda x: x["rank"])] == want
    assert sorted(x["rank"] for x in out.collect()) == list(range(3000))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_running_sums_of_hot_null_and_repeated_groups(spark):
    r = random.Random(2)
    rows = [("hot" if k % 3 else r.choice(["a", "b", None]), r.randint(0, 5), r.choice([None, 1, 7]), k) for k in range(2000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g string, key int, v int, id long").repartition(5)
    out = ranks.running(df, ["g"], [F.col("key"), F.col("id")], "v")
    sums, want = {}, []
    for g, key, v, k in sorted(rows, key=lambda x: (x[0] or "", x[1], x[3])):
        want.append((str(g), key, k, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + (v or 0)
    assert sorted((str(x["g"]), x["key"], x["id"], x["before"]) for x in out.collect()) == sorted(want)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert ranks.numbered(none, F.col("v")).collect() == []
    assert ranks.running(none, ["g"], [F.col("v")], "v").collect() == []


def test_no_machine_local_folder_on_a_cluster():
    class Frame:
        class sparkSession:
            class conf:
                get = staticmethod(lambda *_: None)

            class sparkContext:
                master = "spark://host:7077"
                getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.settled(Frame)
