"""Bucketed storage: joins and rollups on the entity without shuffles."""

import os

from pyspark.sql import functions as F

from terrapanel.operators import panel as P
from terrapanel.operators import rollup as R
from terrapanel.plans import panel_queries as PQ
from terrapanel.plans import tables as T
from terrapanel.sources.layout import bucket_count, bucketed, drop_bucketed, exchanges, lay_out

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def no_broadcast(spark):
    """Plans as of sides too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def with_broadcast(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_star_joins_have_no_exchange_and_one_scan_a_source(spark):
    no_broadcast(spark)
    try:
        base, sources = PQ._star(spark, SF)
        panel = P.integrate_panel(base, sources, PQ._STAR_KEYS)
        assert exchanges(panel) == 0
        plan = panel._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 + sum(s is not None for s in sources.values())
        assert plan.count("Join") == 5 and panel.count() == base.count()
    finally:
        with_broadcast(spark)


def test_panel_from_measurements_needs_no_exchange(spark):
    no_broadcast(spark)
    try:
        stored = T.measurements(spark, SF)
        measures, days = T.panel_and_days(stored)
        keys = ["grid_id", "year", "month"]
        assert exchanges(measures) == 0 and exchanges(days) == 0
        assert exchanges(measures.join(days, keys, "left")) == 0
        same = measures.select(*T.MEASURES, *keys).exceptAll(T.panel(spark, SF).select(*T.MEASURES, *keys))
        assert same.count() == 0 and measures.count() == T.panel(spark, SF).count()
        assert days.exceptAll(T.days(spark, SF).select(days.columns)).count() == 0
        drop_bucketed(stored)
    finally:
        with_broadcast(spark)


def test_layout_keeps_rows_and_nulls_and_is_dropped(spark):
    rows = [(i % 17 if i % 9 else None, 2000 + i % 5, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "grid_id long, year int, v double").repartition(7)
    out = lay_out({"a": df, "b": df, "c": None}, "grid_id", 4)
    assert out["a"] is out["b"] and out["c"] is None
    assert sorted(map(str, out["a"].collect())) == sorted(map(str, df.collect()))
    assert len([f for f in out["a"].inputFiles()]) <= 4
    name = out["a"]._table
    drop_bucketed(out["a"])
    assert not spark.catalog.tableExists(name)
    assert bucket_count(df, 10) == 30


def test_rollup_stays_in_buckets_and_groups_of_any_size(spark):
    """One grid with a third of all rows."""
    rows = [(0 if i % 3 == 0 else i % 50, 2000 + i % 4, i % 12 + 1, 1.0) for i in range(3000)]
    df = bucketed(spark.createDataFrame(rows, "grid_id int, year int, month int, v double"), "grid_id", 8, ("year", "month"))
    per = df.groupBy("grid_id", "year", "month").agg(F.sum("v").alias("v"))
    assert exchanges(per) == 0 and per.agg(F.sum("v")).first()[0] == 3000.0
    assert R.rollup(df, ("grid_id", "year"), {"v": "sum"}).filter("grid_id = 0").agg(F.sum("v")).first()[0] > 1000
    drop_bucketed(df)
