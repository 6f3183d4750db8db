"""Outputs: ordered folders written by the executors, and single files put together on the driver."""

from __future__ import annotations

import gzip
import itertools
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.errors import InputOutputError, UsageError
from collatrix.functions.encoding import encode, mark_of
from collatrix.sources.sample import split_quoted
from collatrix.sources.xlsx import write_sheet
from collatrix.spec import SortSpec

AUDIT_BYTES, AUDIT_KEPT = 10 << 20, 5
#: Names of outputs that are one file by their nature.
SINGLE = (".xlsx", ".zip")


def guard_output(spec: SortSpec) -> None:
    """Refuse to write over an input, or over a file without leave; keep a backup if asked to."""
    out = Path(spec.output)
    for source in (spec.input, *spec.merge):
        if source and out.exists() and os.path.exists(source) and os.path.samefile(out, source):
            raise UsageError("input and output are the same file")
    if out.exists():
        if spec.backup:
            shutil.copy2(out, f"{out}.bak")
        elif not spec.force:
            raise UsageError(f"{out} exists; force or backup lets it be replaced")


def write_folder(rows: DataFrame, by: list[Column], path: str, header: str | None = None, encoding: str = "utf-8", mode: str = "overwrite") -> list[str]:
    """Part files in order, each sorted, the header as the first part: the sink for outputs of any size.
    A target ending in ``.gz`` has compressed parts. Text in UTF-8 only."""
    if dict(rows.dtypes)["value"] == "binary" or encoding != "utf-8" or path.lower().endswith(SINGLE):
        raise UsageError("a folder holds UTF-8 text")
    if header is not None:
        first = rows.sparkSession.createDataFrame([(header, 0)], "value string, pos long")
        rows, by = first.unionByName(rows.select("value", "pos")), [F.col("pos")]
    options = {"compression": "gzip"} if path.lower().endswith(".gz") else {}
    rows.orderBy(*by).select("value").write.mode(mode).options(**options).text(path)
    return [path]


def ordered_values(rows: DataFrame, by: list[Column]) -> Iterator:
    """Values in order, one range partition at a time on the driver."""
    return (r["value"] for r in rows.orderBy(*by).select("value").toLocalIterator(prefetchPartitions=True))


def _bytes_of(values: Iterator, header: str | None, encoding: str) -> Iterator[bytes]:
    yield mark_of(encoding)
    if header is not None:
        yield encode(header + "\n", encoding)
    for v in values:
        yield bytes(v)[::-1] if not isinstance(v, str) else encode(v + "\n", encoding)


def commit(path: Path, write) -> None:
    """Write beside the target and put it in place at once."""
    part = path.parent / f".{path.name}.part"
    try:
        write(part)
        with open(part, "rb") as f:
            os.fsync(f.fileno())
        os.replace(part, path)
    except OSError as e:
        part.unlink(missing_ok=True)
        raise InputOutputError(str(e)) from e


def write_single(values: Iterator, path: str, header: str | None = None, encoding: str = "utf-8", sheet: str | None = None, delimiter: str = ",") -> None:
    """One file; its name says whether it is gzip, zip or a spreadsheet."""
    target = Path(path)
    low = path.lower()
    if low.endswith(".xlsx"):
        lines = ([header] if header is not None else []), values
        rows = (split_quoted(x, delimiter) for part in lines for x in part)
        return commit(target, lambda p: write_sheet(str(p), rows, sheet or "Sorted", header is not None))
    pieces = _bytes_of(values, header, encoding)

    def write(part: Path) -> None:
        if low.endswith(".gz"):
            with gzip.open(part, "wb") as f:
                f.writelines(pieces)
        elif low.endswith(".zip"):
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z, z.open(target.stem, "w", force_zip64=True) as f:
                for piece in pieces:
                    f.write(piece)
        else:
            with open(part, "wb") as f:
                f.writelines(pieces)

    return commit(target, write)


def local_master(spark: SparkSession) -> bool:
    """Whether all tasks run on this machine, so that they can write where the driver does."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def write_parts(rows: DataFrame, path: str, header: str | None = None, encoding: str = "utf-8") -> list[str]:
    """``rows`` (value, pos, part) as numbered files, the header in each, in one pass: a part's rows meet
    in one task, sorted, which writes its file and then puts it in place. The folder must be one
    that the tasks share with the driver."""
    target = Path(path).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    name_of = lambda part: target.with_name(f"{target.stem}-{part:03d}{target.suffix}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_in = ((p, v) for b in batches for p, v in zip(b.column("part").to_pylist(), b.column("value").to_pylist(), strict=True))
        for part, group in itertools.groupby(rows_in, key=lambda r: r[0]):
            own = name_of(part)
            hidden = own.with_name(f".{own.name}.{uuid.uuid4().hex}")
            with open(hidden, "wb") as f:
                f.writelines(_bytes_of((v for _, v in group), header, encoding))
                f.flush()
                os.fsync(f.fileno())
            os.replace(hidden, own)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    dealt = rows.select("part", "pos", "value").repartition("part").sortWithinPartitions("part", "pos")
    parts = sorted(r.part for r in dealt.mapInArrow(run, "part int").collect())  # one number a file
    return [str(Path(path).with_name(name_of(p).name)) for p in parts]


def audit(path: str, entry: dict) -> bool:
    """Append one JSON line, turning full logs over; a failure doesn't end a run."""
    try:
        log = Path(path)
        if log.exists() and log.stat().st_size > AUDIT_BYTES:
            for i in range(AUDIT_KEPT - 1, 0, -1):
                if (old := Path(f"{path}.{i}")).exists():
                    old.replace(f"{path}.{i + 1}")
            log.replace(f"{path}.1")
        with log.open("a") as f:
            f.write(json.dumps(entry) + "\n")
    except OSError:
        return False
    return True
