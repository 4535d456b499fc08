"""What Spark sizes too low is not broadcast."""

from pyspark.sql import functions as F

from cattedra.llm import simhash


def test_grid_points_are_not_broadcast(spark):
    """Their size is estimated as that of the classes, of which each has up to 33 points."""
    classes = spark.range(2000).select(F.xxhash64("id").alias("fp")).unionByName(spark.range(4).select(F.col("id").alias("fp")))
    found = simhash.links(classes, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)} <= {(r.a, r.b) for r in found.collect()}
