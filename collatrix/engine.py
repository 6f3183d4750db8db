"""One run: scan, keys, duplicates, order, limit, verification, conversion and output."""

from __future__ import annotations

import os
import tempfile
import time
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix import __version__, runs
from collatrix.budget import PeakMemory, budget
from collatrix.errors import EngineError, InputOutputError, PreflightError, UsageError, VerifyError, as_engine_error
from collatrix.functions.keys import orders
from collatrix.operators.convert import convert
from collatrix.operators.dedup import reduce_duplicates
from collatrix.operators.limit import preview
from collatrix.operators.merge import check_inputs, union_inputs
from collatrix.operators.numeric import sort_file
from collatrix.operators.order import positioned
from collatrix.operators.split import split_by_number, split_by_size
from collatrix.operators.verify import violations
from collatrix.sources.sample import preflight, resolve
from collatrix.sources.scan import read_many, read_records
from collatrix.sources.sink import SINGLE, audit, commit, guard_output, local_master, ordered_values, write_folder, write_parts, write_single
from collatrix.spec import SortSpec
from collatrix.staging import scope


@dataclass
class Ordered:
    """Records that are to be put out: ``rows`` (value, keys, _rid) in no order, sorted by ``by``."""

    rows: DataFrame
    header: str | None
    spec: SortSpec

    @property
    def by(self) -> list:
        return orders(self.spec)

    def frame(self) -> DataFrame:
        """The ordered records."""
        return self.rows.orderBy(*self.by)


def plan(spark: SparkSession, spec: SortSpec) -> tuple[Ordered, DataFrame]:
    """The lazy table of what a run puts out, and of the records it reads."""
    if spec.merge:
        spec = spec.with_(header=bool(spec.header), delimiter=spec.delimiter or ("," if spec.format == "csv" else None))
        inputs, header = read_many(spark, spec, spec.merge)
        if spec.verify:
            check_inputs(inputs, spec)
        records = union_inputs(inputs)
    else:
        if spec.input is None:
            raise UsageError("an input is needed")
        spec = resolve(spec)
        records, header = read_records(spark, spec)
    rows = reduce_duplicates(records, spec)
    if spec.limit is not None:
        rows = rows.orderBy(*orders(spec)).limit(spec.limit)
    return Ordered(rows, header, spec), records


def _preflight(spark: SparkSession, spec: SortSpec) -> None:
    """Room for the run on this machine: where Spark spills, and where the output goes."""
    spills = spark.sparkContext.getConf().get("spark.local.dir", None) or tempfile.gettempdir()
    target = os.path.dirname(os.path.abspath(spec.output))
    for path in (spec.input, *spec.merge):
        if path is not None:
            preflight(path, [d for d in dict.fromkeys((spills.split(",")[0], target)) if os.path.isdir(d)])


def _run(spark: SparkSession, spec: SortSpec, peak: PeakMemory) -> dict:
    began = time.time()
    for path in (spec.input, *spec.merge):
        if path is not None and not os.path.exists(path):
            raise PreflightError(f"{path} isn't there")
    if spec.output is None and spec.preview is None:
        raise UsageError("an output is needed")
    if spec.output is not None and spec.preview is None:
        guard_output(spec)
        if local_master(spark):
            _preflight(spark, spec)
    run, marks = None, []
    if spec.resume:
        run = runs.take_up(spec, spec.input) or runs.start(spec, spec.input)
        run.lock()
    try:
        if _plain_numbers(spark, spec):
            rows_in, rows_out = sort_file(spark, spec, commit)
            return _report(spec, began, [time.time()] * 2, rows_in, rows_out, [spec.output], False, peak)
        ordered, records = plan(spark, spec)
        spec = ordered.spec
        rows_in = run.manifest["rows_in"] if run and run.staged else records.count()
        marks.append(time.time())
        if run:  # keys and duplicates are done once; order and output are cheap to redo
            if not run.staged:
                ordered.rows.write.mode("overwrite").parquet(str(run.data))
                run.save(rows_in=rows_in)
            ordered.rows = spark.read.schema(ordered.rows.schema).parquet(str(run.data))
        if spec.preview is not None:
            total, rows = preview(ordered.rows.select("value", "_rid"), spec, spec.preview)
            shown = rows.orderBy("pos").collect()
            text = lambda v: v if isinstance(v, str) else str(int.from_bytes(bytes(v), "big"))
            return {"status": "ok", "input": spec.input, "total_rows": total, "head": [text(r.value) for r in shown if r.side == "head"], "tail": [text(r.value) for r in shown if r.side == "tail"]}
        placed = positioned(ordered.rows, ordered.by, "output")
        rows_out = placed.count()
        marks.append(time.time())
        if spec.verify:
            wrong = violations(placed, spec).count()
            reduces = spec.unique or spec.distinct or spec.dedupe_by or spec.limit is not None
            if wrong or rows_out > rows_in or (rows_out != rows_in and not reduces):
                raise VerifyError(f"{wrong} records out of order, {rows_in} rows in, {rows_out} rows out")
        out, header = convert(placed, spec, ordered.header)
        encoding = spec.encoding_out or (spec.encoding_in if spec.format != "excel" else None) or "utf-8"
        files = [spec.output]
        if spec.split_by is not None:
            files = write_parts(split_by_number(out, spec.split_by), spec.output, header, encoding)
        elif spec.split_bytes is not None:
            head = len(header.encode()) + 1 if header is not None else 0
            files = write_parts(split_by_size(out, spec.split_bytes, head), spec.output, header, encoding)
        elif _layout(spark, spec, encoding) == "folder":
            write_folder(out, [F.col("pos")], spec.output, header, encoding)
        else:
            write_single(ordered_values(out, [F.col("pos")]), spec.output, header, encoding, spec.sheet, spec.delimiter or ",")
        if run:
            run.save(finished=True)
            run.remove()
    finally:
        if run:
            run.unlock()
    return _report(spec, began, marks, rows_in, rows_out, files, ordered.header is not None, peak)


def _layout(spark: SparkSession, spec: SortSpec, encoding: str) -> str:
    """A folder or a file: as asked, else a folder where tasks run on other machines, for what it can hold."""
    if spec.format == "numeric":
        return "file"
    packed = spec.output.lower().endswith(SINGLE)
    return spec.output_layout or ("file" if local_master(spark) or encoding != "utf-8" or packed else "folder")


def _plain_numbers(spark: SparkSession, spec: SortSpec) -> bool:
    """Whether numbers go from one plain file to another, on a machine where tasks can write the output."""
    plain = spec.input is not None and not spec.input.lower().endswith((".gz", ".zip")) and os.path.isfile(spec.input)
    aside = spec.resume or spec.preview is not None or spec.split_by is not None or spec.split_bytes is not None
    return spec.format == "numeric" and plain and not aside and local_master(spark) and not spec.output.lower().endswith((".gz", ".zip"))


def _report(spec: SortSpec, began: float, marks: list[float], rows_in: int, rows_out: int, files: list[str], header: bool, peak: PeakMemory) -> dict:
    total = time.time() - began
    size = sum(os.path.getsize(p) for p in (spec.input, *spec.merge) if p)
    rows_in_s, rows_sorted_s = (mark - began for mark in marks)
    return {
        "status": "ok", "version": __version__, "input": spec.input or list(spec.merge), "output": spec.output, "files": files, "format": spec.format,
        "input_bytes": size, "records": rows_out, "rows_in": rows_in, "rows_out": rows_out, "dupes_removed": rows_in - rows_out if spec.limit is None else 0,
        "options": {"reverse": spec.reverse, "unique": spec.unique, "header": header, "limit": spec.limit},
        "timing": {"read_s": rows_in_s, "sort_s": rows_sorted_s - rows_in_s, "merge_s": total - rows_sorted_s, "total_s": total}, "throughput_mb_per_min": size / (1 << 20) / max(total, 1e-9) * 60,
        "peak_ram_bytes": peak.bytes, "mem_limit_bytes": spec.max_memory, "verified": bool(spec.verify), "exit_code": 0,
    }


def run(spark: SparkSession, spec: SortSpec) -> dict:
    """Do what ``spec`` says and report on it. Failures are ``EngineError`` with an exit code. What a run
    stages is removed at its end."""
    try:
        with scope(), budget(spark, spec), PeakMemory() as peak:
            report = _run(spark, spec, peak)
    except EngineError as e:
        failure: EngineError = e
    except PySparkException as e:
        found = as_engine_error(e)
        failure = found if isinstance(found, EngineError) else InputOutputError(str(e)[:500])
    else:
        if spec.log_file:
            audit(spec.log_file, report)
        return report
    if spec.log_file:
        audit(spec.log_file, {"status": "error", "input": spec.input, "exit_code": failure.code, "error": str(failure)})
    raise failure
