"""Duplicate removal whose meaning depends on the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatrix.functions.keys import dedupe_key, orders, record_key
from collatrix.operators.order import positioned, with_keys, with_neighbour
from collatrix.spec import SortSpec


def unique(records: DataFrame, spec: SortSpec) -> DataFrame:
    """Records less those equal to the one before them in the order (``distinct``: to any before).

    Whole-record sorts bring equal records together, so there it is one grouping, which combines
    before the shuffle. Records ordered by keys can be equal and apart; both then stay.
    """
    if spec.distinct or spec.format == "numeric" or (spec.format == "string" and not spec.ignore_case):
        keyed = with_keys(records, spec).withColumn("_u", record_key(spec))
        first = F.struct(*[c for c in keyed.columns if c != "_u"])
        kept = keyed.groupBy("_u").agg(F.min_by(first, "_rid").alias("r"))
        return kept.select(*[F.col(f"r.{c}").alias(c) for c in keyed.columns if c != "_u"])
    rows = positioned(with_keys(records, spec), orders(spec), "unique")
    rows = with_neighbour(rows, record_key(spec), "_before", ahead=False)
    return rows.filter(F.col("_before").isNull() | ~record_key(spec).eqNullSafe(F.col("_before.v"))).drop("_before", "_part", "pos")


def dedupe_first(records: DataFrame, spec: SortSpec) -> DataFrame:
    """The first record, in the order, of each dedupe key, however far apart they stand. The filter on
    the row number lets Spark keep one row a key and task before the shuffle."""
    keyed = with_keys(records, spec).withColumn("_dk", dedupe_key(spec))
    rank = F.row_number().over(Window.partitionBy("_dk").orderBy(*orders(spec)))
    return keyed.withColumn("_n", rank).filter("_n = 1").drop("_n", "_dk")


def dedupe_last(records: DataFrame, spec: SortSpec) -> DataFrame:
    """The last record of each run of equal dedupe keys in the order."""
    rows = positioned(with_keys(records, spec).withColumn("_dk", dedupe_key(spec)), orders(spec), "dedupe")
    rows = with_neighbour(rows, F.col("_dk"), "_next", ahead=True)
    return rows.filter(F.col("_next").isNull() | ~F.col("_dk").eqNullSafe(F.col("_next.v"))).drop("_next", "_dk", "_part", "pos")


def reduce_duplicates(records: DataFrame, spec: SortSpec) -> DataFrame:
    """What ``spec`` asks for; records come back with their key columns, in no order."""
    if spec.unique or spec.distinct:
        records = unique(records, spec).select("value", "_rid")
    if spec.dedupe_by:
        return dedupe_first(records, spec) if spec.dedupe_keep == "first" else dedupe_last(records, spec)
    return with_keys(records, spec)
