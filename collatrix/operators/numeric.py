"""Sorting plain files of 8-byte numbers: numbers stay primitive longs from file to file.

A number is held as a signed long with its top bit turned, so that signed order is unsigned order and
Spark sorts by radix. Equal numbers are the same record, so nothing else travels with them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.errors import DataError, InputOutputError, VerifyError
from collatrix.sources.scan import NUMBER_BYTES, ranges_of
from collatrix.spec import SortSpec
from collatrix.staging import stage

_TOP = np.uint64(1 << 63)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, length in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "length")], strict=True):
            with open(path, "rb") as f:
                f.seek(start)
                for at in range(0, length, NUMBER_BYTES):
                    raw = np.frombuffer(f.read(min(NUMBER_BYTES, length - at)), "<u8")
                    yield pa.RecordBatch.from_arrays([pa.array((raw ^ _TOP).view(np.int64))], names=["v"])


def read_longs(spark: SparkSession, path: str) -> DataFrame:
    size = os.path.getsize(path)
    if size % 8:
        raise DataError(f"{path}: {size} bytes aren't whole 8-byte numbers")
    return ranges_of(spark, [(path, size)]).mapInArrow(_read, "v long")


def placed(rows: DataFrame, spec: SortSpec) -> tuple[DataFrame, int]:
    """(pos, v) in order, and how many. Sorted rows are staged with their number in their range; one
    row a range gives the offsets."""
    if spec.unique or spec.distinct:
        rows = rows.distinct()
    ordered = rows.orderBy(F.col("v").desc() if spec.reverse else F.col("v"))
    ordered = ordered.limit(spec.limit) if spec.limit is not None else ordered
    kept = stage(ordered.withColumn("_seq", F.monotonically_increasing_id()), "numbers").withColumn("_part", F.shiftright("_seq", 33))
    sizes = stage(kept.groupBy("_part").agg(F.count("*").alias("_n")), "numbers-ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    pos = (F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).alias("pos")
    return kept.join(F.broadcast(offsets), "_part").select(pos, "v"), sizes.agg(F.sum("_n").alias("n")).first().n or 0


def fill(rows: DataFrame, path: str, total: int) -> None:
    """Write ``rows`` (pos, v) into the file at ``path``: tasks write runs of neighbours at their places,
    so all write at once, and a task that is run again writes the same."""
    with open(path, "wb") as f:
        f.truncate(8 * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = 0
        fd = os.open(path, os.O_WRONLY)
        try:
            for batch in batches:
                pos, v = np.array(batch.column("pos")), np.array(batch.column("v"))
                if not len(pos):
                    continue
                if (np.diff(pos) < 0).any():
                    order = np.argsort(pos, kind="stable")
                    pos, v = pos[order], v[order]
                raw = v.view(np.uint64) ^ _TOP
                edge = np.flatnonzero(np.diff(pos, prepend=pos[0] - 2) != 1)
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(pos)], strict=True):
                    os.pwrite(fd, raw[a:b].astype("<u8").tobytes(), 8 * (int(pos[a]) - 1))
                many += len(pos)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([many])], names=["n"])

    done = rows.mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0
    if done != total:
        raise InputOutputError(f"{done} of {total} records written")


def file_violations(spark: SparkSession, path: str, reverse: bool) -> int:
    """Numbers of the file that must stand before the one just before them. Ranges are read in parallel,
    each with the last number of the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = 0
        for batch in batches:
            for name, start, length in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "length")], strict=True):
                with open(name, "rb") as f:
                    for at in range(start, start + length, NUMBER_BYTES):
                        first = max(0, at - 8)
                        f.seek(first)
                        raw = np.frombuffer(f.read(min(at + NUMBER_BYTES, start + length) - first), "<u8")
                        wrong += int((raw[1:] > raw[:-1]).sum() if reverse else (raw[1:] < raw[:-1]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([wrong])], names=["n"])

    return ranges_of(spark, [(path, os.path.getsize(path))]).mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0


def sort_file(spark: SparkSession, spec: SortSpec, commit) -> tuple[int, int]:
    """Rows in and out of a run from file to file; ``commit`` puts the finished file in place."""
    rows_in = os.path.getsize(spec.input) // 8
    rows, total = placed(read_longs(spark, os.path.abspath(spec.input)), spec)

    def write(part: Path) -> None:
        fill(rows, str(part), total)
        if spec.verify:
            wrong = file_violations(spark, str(part.absolute()), spec.reverse)
            reduces = spec.unique or spec.distinct or spec.limit is not None
            if wrong or total > rows_in or (total != rows_in and not reduces):
                raise VerifyError(f"{wrong} records out of order, {rows_in} rows in, {total} rows out")

    commit(Path(spec.output), write)
    return rows_in, total
