"""Parts of an ordered output, by number of parts or by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatrix.staging import stage


def split_by_number(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``part`` from 1: as many rows each as fill ``parts`` parts, the last with what is left. There
    may be fewer parts than asked for. ``rows`` have ``pos``."""
    total = rows.count()
    each = max(1, -(-total // parts))
    return rows.withColumn("part", (F.floor((F.col("pos") - 1) / each) + 1).cast("int"))


def _walk(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, pos) of the first record of each part, by one search a part in a batch's running sum."""
        part, used = 0, most + 1
        for batch in batches:
            pos, size = np.array(batch.column(0)), np.array(batch.column(1))
            total = np.cumsum(size)
            at, starts = 0, []
            while at < len(size):
                before = total[at] - size[at]
                upto = max(at, int(np.searchsorted(total, before + most - used, "right")))  # records that still fit
                used += int(total[upto - 1] - before) if upto > at else 0
                if upto < len(size):
                    part += 1
                    starts.append((part, pos[upto]))
                    used = int(size[upto])
                    upto += 1
                at = upto
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in starts], pa.int32()), pa.array([x for _, x in starts], pa.int64())], names=["part", "pos"])

    return run


def split_by_size(rows: DataFrame, most: int, header_bytes: int = 0) -> DataFrame:
    """Add ``part`` from 1: filled in order up to ``most`` bytes, header and newlines counted; a longer
    record is a part of its own. ``rows`` come from ``positioned``.

    Where a part ends depends on all before it, so one task walks over (pos, bytes), 16 bytes a
    record, behind an exchange: texts are read and measured by all tasks. Starts are joined to the
    rows by position; rows between them take the last start of their range, or of the ranges before.
    """
    lengths = rows.select("pos", (F.octet_length("value") + 1).cast("long").alias("size"))
    starts = stage(lengths.repartition(1).sortWithinPartitions("pos").mapInArrow(_walk(most - header_bytes), "part int, pos long"), "parts")
    placed = rows.join(starts.withColumnRenamed("part", "_start"), "pos", "left")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_part").agg(F.max("pos").alias("pos"))  # one row a range
    last = starts.join(rows.select("pos", "_part"), "pos").groupBy("_part").agg(F.max("part").alias("_last"))
    carried = ranges.join(last, "_part", "left").select("_part", F.max("_last").over(upto).alias("_carried"))
    inside = Window.partitionBy("_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(F.broadcast(carried), "_part").withColumn("part", F.coalesce(F.max("_start").over(inside), "_carried"))
    return found.drop("_start", "_carried")
