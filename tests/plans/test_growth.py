"""Rows that queries shuffle, against those that they read."""

from pitloom.plans.composites import a54_leg_backtest
from pitloom.sources.tables import table

SF = "/root/testdata/sf0.01"


def written(spark, run) -> int:
    """The most rows that a stage of run() writes to shuffles."""
    context = spark.sparkContext
    jvm, store = context._jvm, spark._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    after = stages()
    return max(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if s.stageId() not in before)


def test_legs_are_not_copied_for_each_week(spark):
    """As on tables too large to broadcast."""
    lines, name = table(spark, SF, "lineitem").count(), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert written(spark, lambda: a54_leg_backtest(spark, SF).write.mode("overwrite").format("noop").save()) < 2 * lines
    finally:
        spark.conf.set(name, before)
