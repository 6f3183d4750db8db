"""Inputs that are already sorted, as one ordered whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.errors import VerifyError
from collatrix.operators.verify import count_violations
from collatrix.spec import SortSpec


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """Records of all inputs; ties go to the earlier input, then to input order."""
    marked = [df.select("value", F.struct(F.lit(i).alias("file"), F.col("_rid").alias("rid")).alias("_rid")) for i, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, marked)


def check_inputs(inputs: list[DataFrame], spec: SortSpec) -> None:
    """Spark sorts again, which would hide that an input wasn't sorted; so each is looked at."""
    for i, df in enumerate(inputs):
        wrong = count_violations(df, spec)
        if wrong:
            raise VerifyError(f"merge input {i + 1} isn't sorted: {wrong} records are out of order")
