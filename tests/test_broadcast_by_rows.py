"""A table that is small only as a file is not broadcast by its file's size."""

from pyspark.sql import functions as F

from decretum.sources import tables as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_inside_are_left_to_run_time(spark):
    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    fixed, adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(name, None)
    rows = S.settle(spark.range(100_000).select("id", F.lit("x" * 500).alias("text")))
    wide = S.settle(spark.range(100_000))
    assert "BroadcastHashJoin" in _plan(wide.join(rows, "id"))
    with S.broadcast_by_rows(spark):
        met = wide.join(rows, "id")
        assert "BroadcastHashJoin" not in _plan(met)
        done = S.settle(met)
        assert done.count() == 100_000
        # the 50 MB of rows are not broadcast at run time either, a few rows are
        few = wide.join(rows.where("id < 5"), "id")
        few.collect()
        assert "BroadcastHashJoin" in _plan(few)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == fixed and spark.conf.get(name, None) == adaptive
