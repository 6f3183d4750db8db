"""Total orders that stay distributed: sorting, positions and neighbours without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.functions.keys import key_columns, orders, parsed_record
from collatrix.spec import SortSpec
from collatrix.staging import stage


def with_keys(records: DataFrame, spec: SortSpec) -> DataFrame:
    parsed = parsed_record(spec)
    if parsed is not None:
        records = records.withColumn("_parsed", parsed)
    return records.withColumns(key_columns(spec)).drop("_parsed")


def sort(records: DataFrame, spec: SortSpec) -> DataFrame:
    """Records (value, _rid) in order. Equal keys keep input order, reversed runs included."""
    return with_keys(records, spec).orderBy(*orders(spec))


def positioned(df: DataFrame, by: list[Column], tag: str = "ordered") -> DataFrame:
    """``df`` with ``pos`` from 1 in the order ``by`` and ``_part``, its range of the order.

    The sorted rows are written once with their number inside their range partition; the ranges'
    sizes (one row a partition) give the offsets. No task holds more than a range.
    """
    rows = stage(df.orderBy(*by).withColumn("_seq", F.monotonically_increasing_id()), tag)
    rows = rows.withColumn("_part", F.shiftright("_seq", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = (F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).alias("pos")
    return rows.join(F.broadcast(offsets), "_part").select(*[c for c in df.columns if c != "pos"], "_part", place)


def with_neighbour(rows: DataFrame, what: Column, name: str, ahead: bool) -> DataFrame:
    """Add ``name``: a struct with ``v``, the value of ``what`` in the next (``ahead``) or previous
    row by ``pos``, null at the end. ``rows`` come from ``positioned``; values over the edge of a
    range come from a table of one row a range."""
    rows = rows.withColumn("_v", F.struct(what.alias("v")))
    window = Window.partitionBy("_part").orderBy("pos")
    inner = (F.lead if ahead else F.lag)("_v").over(window)
    edge = F.min if ahead else F.max
    edges = rows.groupBy("_part").agg(edge(F.struct("pos", "_v")).alias("e"))
    edges = edges.select((F.col("e.pos") + (-1 if ahead else 1)).alias("pos"), F.col("e._v").alias("_edge"))
    found = rows.withColumn("_inner", inner).join(F.broadcast(edges), "pos", "left")
    return found.withColumn(name, F.coalesce("_inner", "_edge")).drop("_inner", "_edge", "_v")


def sort_with_positions(records: DataFrame, spec: SortSpec) -> DataFrame:
    return positioned(with_keys(records, spec), orders(spec))
