"""Helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collatrix.staging import scope, shared_dir, stage, table

__all__ = ["UPPER", "as_row", "from_row", "held_out", "map_arrow", "scope", "shared_dir", "ship", "stage", "table", "text_or_empty", "with_fields"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A batch is held by the JVM and by Python, on its way in and out, in every task of an executor.
BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application: they need not have it installed."""
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="collatrix-"), "collatrix.zip"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "collatrix").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    spark = df.sparkSession
    ship(spark)
    size = spark.conf.get(BATCH_BYTES, None)
    if size is None or int(size.rstrip("b") if size.rstrip("b").isdigit() else 1 << 40) > MOST_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))
    return df.mapInArrow(function, schema)


def as_row(df: DataFrame) -> DataFrame:
    """All columns in one, ``_row``: whatever they are called, they clash with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def from_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def with_fields(df: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """The schema of the columns ``keep`` of ``df`` and ``more`` (DDL)."""
    return T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *T.StructType.fromDDL(more).fields])


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Whether the row is for evaluation only: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
