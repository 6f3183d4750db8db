"""Files as record tables: ``value`` (string, or 8 bytes most significant first) and ``_rid``, a struct
that sorts in input order: (file, start of the split, number in it)."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.errors import DataError, PreflightError, UsageError
from collatrix.functions.encoding import decoded_blocks
from collatrix.spec import SortSpec
from collatrix.staging import stage

#: Larger spreadsheets aren't read: each is one task's work.
MOST_EXCEL_BYTES = 500 << 20
#: Bytes of 8-byte numbers that one task reads, and that it holds at a time.
RANGE_BYTES, NUMBER_BYTES = 64 << 20, 8 << 20


def _rid(file: int) -> Column:
    return F.struct(F.lit(file).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def physical_lines(spark: SparkSession, path: str, file: int = 0) -> DataFrame:
    """Lines between newlines, one carriage return at the end stripped; blank lines are still there.
    Splits of one file are read in parallel; gzip is read by its name. The files of a folder follow one
    another by name, numbered from ``file``: Spark deals them to tasks by size."""
    rows = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r$", "").alias("value")
    parts = sorted(re.sub("^file:/+", "file:/", p) for p in rows.inputFiles())
    if len(parts) < 2:
        return rows.select(value, _rid(file).alias("_rid"))
    numbered = spark.createDataFrame([(p, file + i) for i, p in enumerate(parts)], "_path string, _number int")  # one row a file
    found = rows.select(value, _rid(file).alias("_rid"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_path")).join(F.broadcast(numbered), "_path", "left")
    number = F.coalesce("_number", F.raise_error(F.lit("a file that wasn't listed")).cast("int"))
    return found.select("value", F.struct(number.alias("file"), F.col("_rid.block").alias("block"), F.col("_rid.row").alias("row")).alias("_rid"))


def _by_path(files: DataFrame) -> DataFrame:
    """``source`` of each file: its path where all machines share it, else its content."""
    if all(r.path.startswith("file:") for r in files.select("path").collect()):
        return files.select(F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("source"))
    return files.select(F.col("content").alias("source"))


def _blocks(f) -> Iterator[bytes]:
    with f:
        while block := f.read(NUMBER_BYTES):
            yield block


def _numbered(lines: Iterator[str]) -> Iterator[pd.DataFrame]:
    for at in itertools.count(0, 10_000):
        some = list(itertools.islice(lines, 10_000))
        if not some:  # Arrow takes no empty frame of text
            return
        yield pd.DataFrame({"value": some, "row": range(at, at + len(some))})


def decoded_lines(spark: SparkSession, path: str, encoding: str, file: int = 0) -> DataFrame:
    """Lines of a file that isn't UTF-8: Spark's text source reads no other encoding, so one task
    decodes a file, a block at a time. Byte order marks are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["source"]:
                yield from _numbered(decoded_blocks(_blocks(open(source, "rb") if isinstance(source, str) else io.BytesIO(source)), encoding))

    rows = _by_path(spark.read.format("binaryFile").load(path)).mapInPandas(run, "value string, row long")
    return rows.select("value", F.struct(F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"), F.col("row").alias("row")).alias("_rid"))


def zip_lines(spark: SparkSession, path: str, encoding: str = "utf-8", file: int = 0) -> DataFrame:
    """All entries one after another, nothing between them; a zip file has no splits. Entries are
    unpacked a block at a time, straight from the file where every machine sees it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["source"]:
                with zipfile.ZipFile(source if isinstance(source, str) else io.BytesIO(source)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    if not names:
                        raise ValueError("collatrix data error: the zip file is empty")
                    blocks = (block for n in names for block in _blocks(z.open(n)))
                    yield from _numbered(decoded_blocks(blocks, encoding))

    found = spark.read.format("binaryFile").load(path)
    rows = _by_path(found).mapInPandas(run, "value string, row long")
    return rows.select("value", F.struct(F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"), F.col("row").alias("row")).alias("_rid"))


def excel_lines(spark: SparkSession, path: str, sheet: str | None = None, file: int = 0) -> DataFrame:
    """One sheet (the named or the first) as comma-separated records."""
    from collatrix.sources.xlsx import csv_line, read_sheet

    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size and size.length > MOST_EXCEL_BYTES:
        raise PreflightError("spreadsheets over 500 MB aren't read")
    raw = spark.read.format("binaryFile").load(path).select("content").first().content
    rows = [(csv_line(r), i) for i, r in enumerate(read_sheet(bytes(raw), sheet))]
    table = spark.createDataFrame(rows, "value string, row long")
    return table.select("value", F.struct(F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"), "row").alias("_rid"))


def _read_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, length in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "length")], strict=True):
            with open(path, "rb") as f:
                f.seek(start)
                for at in range(0, length, NUMBER_BYTES):
                    raw = np.frombuffer(f.read(min(NUMBER_BYTES, length - at)), "<u8").byteswap()
                    offsets = np.arange(0, 8 * len(raw) + 1, 8, dtype=np.int32)
                    value = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                    row = pa.array((start + at) // 8 + np.arange(len(raw)))
                    yield pa.RecordBatch.from_arrays([value, row], names=["value", "row"])


def number_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, start, length) of the ranges that tasks read, or nothing if a file isn't under a path that
    all machines see. A length that isn't a multiple of 8 is a data error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    for row in files:
        if row.length % 8:
            raise DataError(f"{row.path}: {row.length} bytes aren't whole 8-byte numbers")
    if not all(r.path.startswith("file:") for r in files):
        return None
    return ranges_of(spark, sorted((unquote(re.sub("^file:(//)?", "", r.path)), r.length) for r in files))


def ranges_of(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(path, start, length): each of the ``files`` (path, bytes) cut between numbers."""
    cores, found = spark.sparkContext.defaultParallelism, []
    for path, size in files or [("", 0)]:
        each = max(8, min(RANGE_BYTES, -(-size // cores)) // 8 * 8)
        many = max(1, -(-size // each))
        start = F.col("id") * each
        length = F.least(F.lit(each).cast("long"), F.lit(size).cast("long") - start)
        found.append(spark.range(0, many, 1, many).select(F.lit(path).alias("path"), start.alias("start"), length.alias("length")))
    return reduce(DataFrame.unionByName, found)


def numbers(spark: SparkSession, path: str, file: int = 0) -> DataFrame:
    """8-byte little-endian unsigned numbers as ``value``, their bytes turned around so that byte order is
    numeric order. Files that every machine sees under a path are read in ranges, a whole block of
    numbers at a time."""
    ranges = number_ranges(spark, path)
    if ranges is None:
        records = spark.sparkContext.binaryRecords(path, 8).map(lambda b: (bytearray(b[::-1]),))
        rows = spark.createDataFrame(records, "value binary").withColumn("row", F.monotonically_increasing_id())
    else:
        rows = ranges.mapInArrow(_read_numbers, "value binary, row long")
    return rows.select("value", F.struct(F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"), F.col("row").alias("row")).alias("_rid"))


def assemble_multiline(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of physical lines joined by newlines until their quotes balance; what is left at the end
    is a record too.

    Two passes: each split sums its quotes, a table of one row a split gives the parity that each
    split starts with and the record that reaches into it; then every line knows its record.
    """
    quotes = F.regexp_count("value", F.lit('"'))
    if not lines.filter(quotes % 2 == 1).limit(1).count():
        return lines  # every line is balanced, so each is a record
    split = ["_rid.file", "_rid.block"]
    lines = lines.select("value", "_rid", *[F.col(c).alias(c[5:]) for c in split], quotes.alias("_q"))
    per_split = lines.groupBy("file", "block").agg(F.sum("_q").alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = stage(per_split.select("file", "block", (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) % 2).alias("_entry")), "quotes")

    inside = Window.partitionBy("file", "block").orderBy("_rid")
    rows = lines.join(entry, ["file", "block"])
    before = F.col("_entry") + F.coalesce(F.sum("_q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", F.when(before % 2 == 0, F.col("_rid")))
    rows = stage(rows.withColumn("_own", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))), "lines")
    reaching = rows.groupBy("file", "block").agg(F.max("_start").alias("_last"))
    carried = reaching.select("file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    rows = rows.join(carried, ["file", "block"]).withColumn("_record", F.coalesce("_own", "_carried"))
    joined = rows.groupBy("_record").agg(F.array_sort(F.collect_list(F.struct("_rid", "value"))).alias("l"))
    return joined.select(F.array_join(F.col("l.value"), "\n").alias("value"), F.col("_record").alias("_rid"))


def scan_file(spark: SparkSession, path: str, spec: SortSpec, file: int = 0) -> DataFrame:
    """All records of one file, header included, in the format of ``spec``."""
    low = path.lower()
    if low.endswith((".zst", ".zstd")):
        raise UsageError("zstd files aren't supported")
    if spec.format == "numeric":
        return numbers(spark, path, file)
    encoding = spec.encoding_in or "utf-8"
    if spec.format == "excel" or low.endswith(".xlsx"):
        lines = excel_lines(spark, path, spec.sheet, file)
    elif low.endswith(".zip"):
        lines = zip_lines(spark, path, encoding, file)
    elif encoding in ("utf-8", "utf-8-bom"):
        lines = physical_lines(spark, path, file)
        if encoding == "utf-8-bom":
            lines = lines.withColumn("value", F.when(F.col("_rid.block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    else:
        lines = decoded_lines(spark, path, encoding, file)
    if spec.delimited and not low.endswith(".xlsx"):
        lines = assemble_multiline(lines)
    return lines


def take_header(records: DataFrame) -> tuple[str | None, DataFrame]:
    """The first record as text, and the rest."""
    first = records.select(F.min(F.struct("_rid", "value")).alias("m")).first().m
    if first is None:
        return None, records
    return first.value, records.filter(~_is(first._rid))


def _is(rid) -> Column:
    return (F.col("_rid.file") == rid.file) & (F.col("_rid.block") == rid.block) & (F.col("_rid.row") == rid.row)


def read_records(spark: SparkSession, spec: SortSpec, path: str | None = None, file: int = 0) -> tuple[DataFrame, str | None]:
    """Records to sort, blank ones left out, and the header line if there is one."""
    rows = scan_file(spark, path or spec.input, spec, file)
    header = None
    if spec.header:
        header, rows = take_header(rows)
    return (rows if spec.format == "numeric" else rows.filter("value <> ''")), header


def read_many(spark: SparkSession, spec: SortSpec, paths: tuple[str, ...]) -> tuple[list[DataFrame], str | None]:
    """Each input on its own; the header is that of the first and left out of all."""
    found = [read_records(spark, spec, p, i) for i, p in enumerate(paths)]
    return [rows for rows, _ in found], next((h for _, h in found), None)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
