"""Top-N and previews, as Spark's ordered take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.functions.keys import orders
from collatrix.operators.order import with_keys
from collatrix.spec import SortSpec


def top(records: DataFrame, spec: SortSpec, n: int) -> DataFrame:
    return with_keys(records, spec).orderBy(*orders(spec)).limit(n)


def _flipped(spec: SortSpec) -> list:
    """The exact reverse of ``orders``, input order included."""
    turned = orders(spec.with_(reverse=not spec.reverse))
    return [*turned[:-1], F.col("_rid").desc()]


def preview(records: DataFrame, spec: SortSpec, n: int) -> tuple[int, DataFrame]:
    """Total, and the first and last ``n`` records (side, pos, value), which never overlap."""
    keyed = with_keys(records, spec)
    total = keyed.count()
    head = keyed.orderBy(*orders(spec)).limit(n).collect()  # n rows by the caller's wish
    tail = keyed.orderBy(*_flipped(spec)).limit(min(n, max(0, total - n))).collect()
    rows = [("head", i + 1, r["value"]) for i, r in enumerate(head)]
    rows += [("tail", total - i, r["value"]) for i, r in reversed(list(enumerate(tail)))]
    kind = dict(records.dtypes)["value"]
    return total, records.sparkSession.createDataFrame(rows, f"side string, pos long, value {kind}")
