"""Plans have the shape that scales: ordered takes, combining before shuffles, no one-task windows over rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from collatrix.operators import dedup, limit
from collatrix.operators.order import positioned, sort, with_neighbour
from collatrix.spec import SortSpec

CSV = {"input": "-", "output": "-", "format": "csv", "keys": (0,)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def records(spark, values):
    rows = [(v, (0, 0, i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "value string, _rid struct<file:int,block:long,row:long>")


def test_top_is_an_ordered_take(spark):
    plan = plan_of(limit.top(records(spark, ["b,1", "a,2"]), SortSpec(**CSV), 5))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_sort_is_one_range_exchange(spark):
    plan = plan_of(sort(records(spark, ["b,1", "a,2"]), SortSpec(**CSV)))
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_dedupe_first_limits_groups_before_the_shuffle(spark):
    plan = plan_of(dedup.dedupe_first(records(spark, ["b,1", "a,1"]), SortSpec(**CSV, dedupe_by=(1,))))
    assert plan.count("WindowGroupLimit") == 2


def test_whole_record_unique_combines_before_the_shuffle(spark):
    plan = plan_of(dedup.unique(records(spark, ["b", "a", "b"]), SortSpec(input="-", output="-", format="string", unique=True)))
    assert "partial_min_by" in plan and "Window" not in plan


def test_positions_and_neighbours_over_many_ranges(spark):
    values = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = positioned(records(spark, values).repartition(9), [F.col("value")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    windows = re.findall(r"Window \[(.*?)\]", plan_of(rows))
    assert len(windows) == 1 and "_n" in windows[0]  # only over the sizes of the ranges
    found = with_neighbour(rows, F.col("value"), "before", ahead=False)
    found = with_neighbour(found, F.col("value"), "after", ahead=True).orderBy("pos").collect()
    assert len({r._part for r in found}) > 1
    ordered = sorted(values)
    assert [(r.pos, r.value) for r in found] == list(enumerate(ordered, 1))
    assert [r.before and r.before.v for r in found] == [None, *ordered[:-1]]
    assert [r.after and r.after.v for r in found] == [*ordered[1:], None]


def test_scan_reads_only_what_is_asked(spark):
    from collatrix.plans.catalogue import QUERIES

    plan = plan_of(QUERIES["dedupe_keep_first"](spark, "/root/testdata/sf0.001"))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", plan)
