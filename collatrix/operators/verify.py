"""Whether records stand in order, and whether none were lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.errors import VerifyError
from collatrix.operators.order import positioned, with_keys, with_neighbour
from collatrix.spec import SortSpec


def out_of_order(before: str, spec: SortSpec) -> Column:
    """Whether the row's keys must come before those of the struct column ``before``."""
    wrong, equal = [], F.lit(True)
    for i in range(max(1, len(spec.keys))):
        now, then = F.col(f"_k{i}"), F.col(f"{before}.v.k{i}")
        down = (bool(spec.key_dir) and spec.key_dir[i] == "desc") != spec.reverse
        less = now < then if not down else now > then
        if spec.format not in ("numeric", "string") and spec.key_type != "numeric":
            last = (spec.nulls == "last") != down
            empty, was = now == "", then == ""
            less = F.when(empty != was, was if last else empty).otherwise(less)
        wrong.append(equal & less)
        equal = equal & now.eqNullSafe(then)
    return reduce(Column.__or__, wrong)


def violations(rows: DataFrame, spec: SortSpec) -> DataFrame:
    """Rows (with keys, ``pos`` and ``_part``) that must stand before the row just before them."""
    keys = F.struct(*[F.col(f"_k{i}").alias(f"k{i}") for i in range(max(1, len(spec.keys)))])
    rows = with_neighbour(rows, keys, "_before", ahead=False)
    return rows.filter(F.col("_before").isNotNull() & out_of_order("_before", spec))


def count_violations(records: DataFrame, spec: SortSpec) -> int:
    """Of records in the order of ``_rid``, as in a written file."""
    return violations(positioned(with_keys(records, spec), [F.col("_rid").asc()], "verify"), spec).count()


def verify(records: DataFrame, spec: SortSpec, rows_in: int) -> int:
    """Rows of an output whose order holds; raises if it doesn't, or if rows are lost or added. With a
    reducing option there may be fewer rows, never more."""
    wrong = count_violations(records, spec)
    if wrong:
        raise VerifyError(f"{wrong} records are out of order")
    rows_out = records.count()
    reduces = spec.unique or spec.distinct or bool(spec.dedupe_by) or spec.limit is not None
    if rows_out > rows_in or (rows_out != rows_in and not reduces):
        raise VerifyError(f"{rows_in} rows in, {rows_out} rows out")
    return rows_out
