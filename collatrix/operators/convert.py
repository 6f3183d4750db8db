"""Delimited records as TSV, JSON lines or SQL inserts, all as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.errors import UsageError
from collatrix.functions.keys import bad, fields, redelimit
from collatrix.spec import SortSpec


def column_names(header: str | None, width: int, delimiter: str) -> list[str]:
    """Names of the header line, or col0, col1 and so on."""
    if header is None:
        return [f"col{i}" for i in range(width)]
    out, piece, quoted = [], "", False
    for ch in header:
        if ch == '"':
            quoted = not quoted
            piece += ch
        elif ch == delimiter and not quoted:
            out.append(piece)
            piece = ""
        else:
            piece += ch
    names = [*out, piece]
    return [n[1:-1].replace('""', '"') if len(n) > 1 and n[0] == n[-1] == '"' else n for n in names]


def to_json_line(value: Column, names: list[str], delimiter: str) -> Column:
    """An object with all values as strings; of names and fields the shorter list decides."""
    parts = fields(value, delimiter, quoted=True)
    known = F.from_json(F.lit(json.dumps([json.dumps(n, ensure_ascii=False) for n in names])), "array<string>")  # one literal, however wide the record
    both = F.arrays_zip(F.slice(known, 1, F.least(F.lit(len(names)), F.size(parts))).alias("k"), parts.alias("v"))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    pairs = F.transform(F.filter(both, lambda p: p["k"].isNotNull()), lambda p: F.concat(p["k"], F.lit(":"), quoted(p["v"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def to_insert(value: Column, names: list[str], delimiter: str, table: str) -> Column:
    """One INSERT statement; a record of another width is a data error."""
    parts = fields(value, delimiter, quoted=True)
    columns = ",".join('"' + n.replace('"', '""') + '"' for n in names)
    name = table.replace('"', '""')
    values = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))), ",")
    line = F.concat(F.lit(f'INSERT INTO "{name}" ({columns}) VALUES ('), values, F.lit(");"))
    return F.when(F.size(parts) == len(names), line).otherwise(bad(f"not {len(names)} fields", value))


def convert(records: DataFrame, spec: SortSpec, header: str | None) -> tuple[DataFrame, str | None]:
    """``value`` in the output format, and the header line that goes with it."""
    delimiter, value = spec.delimiter or ",", F.col("value")
    if spec.output_format in (None, "csv"):
        if spec.output_format == "csv" and delimiter != ",":
            joined = lambda x: redelimit(x, delimiter, ",")
            return records.withColumn("value", joined(value)), header and header.replace(delimiter, ",")
        return records, header
    if spec.output_format == "tsv":
        return records.withColumn("value", redelimit(value, delimiter, "\t")), header and header.replace(delimiter, "\t")
    width = len(column_names(header, 0, delimiter)) if header is not None else _width(records, delimiter)
    names = column_names(header, width, delimiter)
    if spec.output_format == "jsonl":
        return records.withColumn("value", to_json_line(value, names, delimiter)), None
    if spec.output_format == "sql":
        return records.withColumn("value", to_insert(value, names, delimiter, spec.sql_table)), None
    raise UsageError(f"no conversion to {spec.output_format}")


def _width(records: DataFrame, delimiter: str) -> int:
    found = records.select(F.size(fields(F.col("value"), delimiter, quoted=True)).alias("n")).first()
    return found.n if found else 0
