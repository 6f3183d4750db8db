"""Queries that go through files: an input is written from a driver table to the shared folder, the command
line sorts it, and the output is read back. Their DuckDB SQL says what the output must hold."""

from __future__ import annotations

import contextlib
import glob
import gzip
import io
import json
import os
import shutil
import time
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix import runs
from collatrix.cli import main
from collatrix.functions.encoding import encode, mark_of
from collatrix.functions.values import grouped, human_size, parse_size, shorten
from collatrix.operators.order import positioned
from collatrix.sources import sample
from collatrix.sources.scan import excel_lines, numbers, physical_lines, scan_file
from collatrix.spec import SortSpec
from collatrix.staging import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
ENCODINGS = ("utf-8-bom", "latin-1", "utf-16le", "utf-16be", "utf-32le", "utf-32be")


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    shared = shared_dir(spark)
    if ":" in shared and not shared.startswith("file:"):
        raise ValueError("file queries need a shared folder with a path")
    path = f"/{shared.removeprefix('file:').lstrip('/')}/collatrix/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _column(df: DataFrame, value: Column, *by: str) -> list[str]:
    """One text a row, in the order ``by``: the inputs here are written by the driver."""
    return [r[0] for r in df.orderBy(*by).select(value).toLocalIterator()]


def _write(path: str, lines: Iterable[str], end: str = "\n", encoding: str = "utf-8") -> str:
    with open(path, "wb") as f:
        f.write(mark_of(encoding))
        f.write(encode("".join(x + end for x in lines), encoding))
    return path


def _write_rows(path: str, df: DataFrame, value: Column, *by: str) -> str:
    """One line a row, in the order ``by``: written by the tasks, put together by the driver block by block."""
    df.orderBy(*by).select(value.alias("value")).write.text(f"file://{path}.parts")
    with open(path, "wb") as f:
        for part in sorted(glob.glob(f"{glob.escape(path)}.parts/part-*")):
            with open(part, "rb") as p:
                shutil.copyfileobj(p, f, 1 << 20)
    return path


def _command(spark: SparkSession, *args: str) -> dict:
    """The command line's report; a failure is an error here."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        code = main(["--force", *args], spark)
    if code:
        raise RuntimeError(f"exit code {code}: {' '.join(args)}")
    return json.loads(said.getvalue())


def _lines(rows: DataFrame) -> DataFrame:
    """(pos, line) of a file's records (value, _rid)."""
    return positioned(rows, [F.col("_rid")], "file-lines").select("pos", F.col("value").alias("line"))


def _lines_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, pos, line) of the lines of files of different names, ``pos`` from 1 in each. All are read at
    once, so the number of jobs doesn't grow with that of files."""
    name = F.col("_metadata.file_name")
    place = F.struct(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    read = spark.read.option("lineSep", "\n").text([f"file://{p}" for p in paths])
    rows = positioned(read.select(name.alias("file"), F.col("value").alias("line"), place.alias("_rid")), [F.col("_rid")], "file-parts")
    before = rows.groupBy("file").agg((F.min("pos") - 1).alias("_before"))  # one row a file
    return rows.join(before, "file").select("file", (F.col("pos") - F.col("_before")).alias("pos"), "line")


def _sorted(spark: SparkSession, lines: Iterable[str], *args: str, source: str = "in.txt", target: str = "out.txt") -> DataFrame:
    return _sorted_file(spark, _write(f"{_folder(spark)}/{source}", lines), *args, target=target)


def _sorted_file(spark: SparkSession, path: str, *args: str, target: str = "out.txt") -> DataFrame:
    output = f"{os.path.dirname(path)}/{target}"
    _command(spark, "--input", path, "--output", output, "--verify", *args)
    return _lines(physical_lines(spark, f"file://{output}"))


def _names(spark: SparkSession, sf_dir: str) -> list[str]:
    return _column(table(spark, sf_dir, "customer"), F.col("c_name"), "c_acctbal", "c_custkey")


def _numbers_file(spark: SparkSession, sf_dir: str, folder: str) -> str:
    found = table(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_orderkey", "o_custkey").toLocalIterator()
    with open(f"{folder}/in.bin", "wb") as f:
        f.writelines(((1 << 64) - 1 - r.o_custkey if r.o_orderkey % 2 == 0 else r.o_custkey).to_bytes(8, "little") for r in found)
    return f"{folder}/in.bin"


def _u64(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
    folder = _folder(spark)
    _command(spark, "--input", _numbers_file(spark, sf_dir, folder), "--output", f"{folder}/out.bin", "--verify", *args)
    rows = positioned(numbers(spark, f"file://{folder}/out.bin"), [F.col("_rid")], "file-numbers")
    return rows.select("pos", F.conv(F.hex("value"), 16, 10).alias("number"))


def file_u64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-byte numbers, half of them over 2**63."""
    return _u64(spark, sf_dir)


def file_u64_unique_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u64(spark, sf_dir, "--unique", "--reverse", "--limit", "100")


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriage returns, blank lines and no newline at the end."""
    folder = _folder(spark)
    with open(f"{folder}/in.txt", "w", newline="") as f:
        f.write("\r\n\r\n".join(_names(spark, sf_dir)))
    _command(spark, "--input", f"{folder}/in.txt", "--output", f"{folder}/out.txt", "--mode", "string", "--verify")
    return _lines(physical_lines(spark, f"file://{folder}/out.txt"))


def file_csv_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter and header are found out; the header stays on top."""
    rows = _column(table(spark, sf_dir, "customer"), F.concat_ws(";", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
    return _sorted(spark, ["name;nation;segment", *rows], "--format", "csv", "--key-column", "1", "--key-type", "numeric")


def file_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":{"age":"'), "user_id", F.lit('"}}'))
    path = _write_rows(f"{_folder(spark)}/in.txt", table(spark, sf_dir, "events"), event, "event_id")
    return _sorted_file(spark, path, "--mode", "jsonl", "--key-field", "user.age", "--key-type", "numeric", "--reverse")


def file_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    with gzip.open(f"{folder}/in.gz", "wt") as f:
        f.writelines(x + "\n" for x in _names(spark, sf_dir))
    _command(spark, "--input", f"{folder}/in.gz", "--output", f"{folder}/out.gz", "--mode", "string", "--verify")
    return _lines(physical_lines(spark, f"file://{folder}/out.gz"))


def file_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries in, one out."""
    folder, names = _folder(spark), _names(spark, sf_dir)
    with zipfile.ZipFile(f"{folder}/in.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in (0, 1):
            z.writestr(f"half{i}", "".join(x + "\n" for x in names[i::2]))
    _command(spark, "--input", f"{folder}/in.zip", "--output", f"{folder}/out.zip", "--mode", "string", "--verify")
    return _lines(scan_file(spark, f"file://{folder}/out.zip", SortSpec(input="-", format="string")))


def file_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names in six encodings, kept, and one turned into another."""
    names = [f"{r.n_name} é{r.n_nationkey}" for r in table(spark, sf_dir, "nation").orderBy(F.desc("n_nationkey")).collect()]  # 25 rows
    folder, found = _folder(spark), []
    for i, (read, written) in enumerate([*[(e, e) for e in ENCODINGS], ("utf-16le", "latin-1")]):
        path = _write(f"{folder}/in{i}.txt", names, encoding=read)
        given = ["--encoding-in", read] if read == "latin-1" else []
        _command(spark, "--input", path, "--output", f"{folder}/out{i}.txt", "--mode", "string", "--encoding-out", written, *given)
        raw = open(f"{folder}/out{i}.txt", "rb").read()
        marked = "yes" if mark_of(written) and raw.startswith(mark_of(written)) else "no"
        rows = scan_file(spark, f"file://{folder}/out{i}.txt", SortSpec(input="-", format="string", encoding_in=written))
        found.append(_lines(rows).select(F.lit(read).alias("read"), F.lit(written).alias("written"), F.lit(marked).alias("marked"), "pos", "line"))
    return reduce(DataFrame.unionByName, found)


def file_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from collatrix.sources.xlsx import write_sheet

    folder = _folder(spark)
    rows = [[str(r.n_nationkey), r.n_name, f"0{r.n_regionkey}"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    write_sheet(f"{folder}/in.xlsx", [["id", "name, of nation", "code"], *rows], bold_first=True)
    _command(spark, "--input", f"{folder}/in.xlsx", "--output", f"{folder}/out.xlsx", "--mode", "excel", "--multi-key", "2,1", "--key-dir", "desc,asc", "--header", "--sheet", "Sorted")
    return _lines(excel_lines(spark, f"file://{folder}/out.xlsx"))


def file_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sorted files; equal lines come from the first one first, so only their order can be told."""
    folder, orders = _folder(spark), table(spark, sf_dir, "orders")
    halves = [orders.filter(F.pmod(F.xxhash64("o_orderkey"), 2) == i) for i in (0, 1)]
    paths = [_write_rows(f"{folder}/in{i}.txt", half, F.col("o_orderpriority"), "o_orderpriority", "o_orderkey") for i, half in enumerate(halves)]
    _command(spark, "--merge", *paths, "--output", f"{folder}/out.txt", "--mode", "string", "--verify")
    return _lines(physical_lines(spark, f"file://{folder}/out.txt"))


def _quoted(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
    """Nations with quotes, delimiters and apostrophes in their names."""
    name = F.concat(F.lit("\"O'"), "n_name", F.lit(', ""the"" '), "n_nationkey", F.lit('"'))
    rows = _column(table(spark, sf_dir, "nation"), F.concat_ws(",", "n_nationkey", name, "n_regionkey"), "n_name")
    return _sorted(spark, ["id,name,region", *rows], "--format", "csv", "--key-column", "0", "--key-type", "numeric", "--header", "--delimiter", ",", *args)


def file_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir, "--output-format", "csv")


def file_to_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir, "--output-format", "tsv")


def file_to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir, "--output-format", "jsonl")


def file_to_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir, "--output-format", "sql", "--sql-table", "nations")


def _parts(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
    folder = _folder(spark)
    path = _write(f"{folder}/in.txt", ["c_name", *_names(spark, sf_dir)])
    report = _command(spark, "--input", path, "--output", f"{folder}/out.txt", "--format", "csv", "--key-column", "0", "--header", "--delimiter", ",", *args)
    return _lines_of_files(spark, report["files"])


def file_split_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "--split-by", "4")


def file_split_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "--split-by-size", "8KB")


def file_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output as a folder of ordered parts."""
    folder = _folder(spark)
    path = _write(f"{folder}/in.txt", _names(spark, sf_dir))
    _command(spark, "--input", path, "--output", f"{folder}/out", "--mode", "string", "--output-layout", "folder")
    rows = spark.read.text(f"file://{folder}/out").select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_rid"))
    return _lines(rows)


def file_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was stopped after staging its records is taken up. The staged records are marked, which
    shows in the output that they were used."""
    folder = _folder(spark)
    path = _write(f"{folder}/in.txt", _names(spark, sf_dir))
    before = os.environ.get(runs.TEMP_ENV)
    os.environ[runs.TEMP_ENV] = f"{folder}/runs"
    try:
        spec = sample.resolve(SortSpec(input=path, output=f"{folder}/out.txt", format="string", resume=True, force=True))
        given = SortSpec(input=path, output=f"{folder}/out.txt", format="string", resume=True, force=True)
        stopped = runs.start(given, path)
        from collatrix.engine import plan

        ordered, records = plan(spark, spec)
        ordered.rows.withColumn("value", F.concat("value", F.lit("*"))).write.parquet(str(stopped.data))
        stopped.save(rows_in=records.count())
        _command(spark, "--input", path, "--output", f"{folder}/out.txt", "--mode", "string", "--resume")
    finally:
        os.environ.pop(runs.TEMP_ENV) if before is None else os.environ.__setitem__(runs.TEMP_ENV, before)
    return _lines(physical_lines(spark, f"file://{folder}/out.txt"))


def _mixed_case(spark: SparkSession, sf_dir: str) -> list[str]:
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return _column(table(spark, sf_dir, "customer"), F.concat_ws(",", segment, "c_custkey"), "c_custkey")


def file_unique_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, [x.split(",")[0] for x in _mixed_case(spark, sf_dir)], "--mode", "string", "--ignore-case", "--unique")


def file_dedupe_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, _mixed_case(spark, sf_dir), "--format", "csv", "--delimiter", ",", "--no-header", "--key-column", "1", "--key-type", "numeric", "--dedupe-by", "0", "--ignore-case")


def file_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(",", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = _write_rows(f"{_folder(spark)}/in.txt", table(spark, sf_dir, "orders"), row, "o_orderkey")
    return _sorted_file(spark, path, "--format", "csv", "--delimiter", ",", "--no-header", "--key-column", "1", "--key-type", "date")


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit log says of a run with duplicates and of one that fails."""
    folder = _folder(spark)
    path = _write(f"{folder}/in.txt", _column(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), "o_orderkey"))
    report = _command(spark, "--input", path, "--output", f"{folder}/out.txt", "--mode", "string", "--unique", "--verify", "--log-file", f"{folder}/log", "--max-memory", "256MB", "--threads", "2")
    with contextlib.redirect_stderr(io.StringIO()):
        main(["--input", path, "--output", f"{folder}/out.txt", "--mode", "string", "--log-file", f"{folder}/log"], spark)
    logged = [json.loads(x) for x in open(f"{folder}/log")]
    if report["peak_ram_bytes"] <= 0 or report["timing"]["total_s"] <= 0 or report["throughput_mb_per_min"] <= 0:
        raise RuntimeError("a report without measures")
    rows = [(i, x["status"], x.get("rows_in"), x.get("rows_out"), x.get("dupes_removed"), x.get("verified"), x["exit_code"], x.get("mem_limit_bytes")) for i, x in enumerate(logged)]
    return spark.createDataFrame(rows, "run long, status string, rows_in long, rows_out long, dupes_removed long, verified boolean, exit_code long, mem_limit_bytes long")


def file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a sound file, of one with a bad row in four, and of one whose key is no number."""
    nations = [f"{r.n_nationkey}|{r.n_name}|{r.n_regionkey}" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    folder, rows = _folder(spark), []
    cases = (("sound", nations, 0), ("ragged", [x if i % 4 else x + "|more" for i, x in enumerate(nations)], 0), ("no number", nations, 1))
    for name, lines, key in cases:
        path = _write(f"{folder}/{key}{len(rows)}.csv", ["id|name|region", *lines])
        r = sample.check(path, SortSpec(input=path, format="csv", keys=(key,), key_type="numeric", header=True))
        rows.append((name, r["size_bytes"], r["delimiter"], r["header"], r["columns"], r["bad_rows"], r["key"], r["status"]))
    return spark.createDataFrame(rows, "name string, size_bytes long, delimiter string, header string, columns long, bad_rows long, key string, status string")


def file_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a run, from a sample of lines of one length."""
    folder = _folder(spark)
    path = _write(f"{folder}/in.txt", _column(table(spark, sf_dir, "orders"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "o_orderkey"))
    r = sample.estimate(path, SortSpec(input=path, format="string"), split_bytes=4096)
    return spark.createDataFrame([(r["size_bytes"], r["est_rows"], r["splits"], r["temp_bytes"], r["seconds"])], "size_bytes long, est_rows long, splits long, temp_bytes long, seconds double")


def file_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, delimiter, header and columns of made files."""
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    folder, rows = _folder(spark), []
    made = {
        "a.csv": ["id;name", *[f"{r.n_nationkey};{r.n_name}" for r in nations]], "b.tsv": [f"{r.n_name}\t{r.n_nationkey}" for r in nations],
        "c.txt": [r.n_name for r in nations], "d.jsonl": [json.dumps({"k": r.n_nationkey}) for r in nations], "e.bin": ["\0" * 7],
    }
    for name, lines in made.items():
        r = sample.inspect(_write(f"{folder}/{name}", lines))
        rows.append((name, r["format"], r["delimiter"], r["header"], ",".join(r["columns"])))
    return spark.createDataFrame(rows, "file string, format string, delimiter string, header boolean, columns string")


def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of an unsorted file, which may overlap."""
    lines = _column(table(spark, sf_dir, "nation"), F.col("n_name"), "n_nationkey")
    shown = sample.file_preview(_write(f"{_folder(spark)}/in.txt", lines), 15)
    rows = [(side, i, x) for side in ("head", "tail") for i, x in enumerate(shown[side], 1)]
    return spark.createDataFrame(rows, "side string, at long, line string")


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, counts and short texts as reports write them."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").limit(100).collect()  # a report of 100 rows
    found = [(r.s_suppkey, human_size(r.s_suppkey**5), grouped(r.s_suppkey**5), parse_size(f"{r.s_suppkey}.5 kb"), shorten(r.s_name, 8)) for r in rows]
    return spark.createDataFrame(found, "s_suppkey long, size string, grouped string, parsed long, short string")


def made_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture generator's first numbers for seed 7, sorted by a run."""
    folder = _folder(spark)
    if main(["gen", f"{folder}/in.bin", "200", "numeric", "7"], spark):
        raise RuntimeError("gen failed")
    _command(spark, "--input", f"{folder}/in.bin", "--output", f"{folder}/out.bin", "--verify")
    rows = positioned(numbers(spark, f"file://{folder}/out.bin"), [F.col("_rid")], "made")
    return rows.select("pos", F.conv(F.hex("value"), 16, 10).alias("number"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the command line by their codes."""
    folder = _folder(spark)
    lines = _write(f"{folder}/in.txt", _column(table(spark, sf_dir, "nation"), F.col("n_name"), "n_nationkey"))
    torn = _write(f"{folder}/torn.bin", ["12"])
    out = ("--output", f"{folder}/out.txt")
    cases = {
        "sound": ("--input", lines, *out, "--mode", "string"), "output exists": ("--input", lines, *out, "--mode", "string"), "same file": ("--input", lines, "--output", lines, "--mode", "string", "--force"),
        "no input": ("--input", f"{folder}/none", "--output", f"{folder}/x", "--mode", "string"), "torn numbers": ("--input", torn, "--output", f"{folder}/y"),
        "unsorted merge": ("--merge", lines, _write(f"{folder}/b.txt", ["b", "a"]), "--output", f"{folder}/z", "--mode", "string", "--verify"),
        "directions": ("--input", lines, "--output", f"{folder}/w", "--format", "csv", "--multi-key", "0,1", "--key-dir", "asc"), "zstd": ("--input", "a.zst", "--output", f"{folder}/v", "--mode", "string"),
    }
    rows = []
    for name, args in cases.items():
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            rows.append((name, main(list(args), spark)))
    return spark.createDataFrame(rows, "name string, exit_code long")


def service_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload, job and download through the HTTP service, with its token."""
    from collatrix.api import serve

    folder = _folder(spark)
    server = serve(spark, _folder(spark), token="t")

    def ask(path: str, body: bytes | None = None, target: str | None = None) -> bytes:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body, {"Authorization": "Bearer t"})
        with urllib.request.urlopen(request) as r:
            if target is None:
                return r.read()
            with open(target, "wb") as f:
                shutil.copyfileobj(r, f)
            return b""

    try:
        name = json.loads(ask("/api/upload?filename=in.txt", "".join(x + "\n" for x in _names(spark, sf_dir)).encode()))["path"]
        job = json.loads(ask("/api/sort", json.dumps({"input": name, "output": "out.txt", "format": "string", "verify": True}).encode()))["id"]
        while (status := json.loads(ask(f"/api/job/{job}"))["status"]) in ("queued", "running"):
            time.sleep(0.1)
        if status != "done":
            raise RuntimeError(f"the job is {status}")
        ask(f"/api/job/{job}/result", target=f"{folder}/result.txt")
    finally:
        server.shutdown()
    return _lines(physical_lines(spark, f"file://{folder}/result.txt"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    file_u64, file_u64_unique_top, file_lines, file_csv_detected, file_jsonl, file_gzip, file_zip, file_encodings, file_excel, file_merge, file_to_csv, file_to_tsv, file_to_jsonl, file_to_sql,
    file_split_number, file_split_size, file_folder, file_resume, file_unique_ignore_case, file_dedupe_ignore_case, file_date_key, file_report, file_check, file_estimate, file_inspect, file_preview,
    text_values, made_numbers, exit_codes, service_sort,
)}

_NUMBERS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 18446744073709551615::UBIGINT - o_custkey::UBIGINT ELSE o_custkey::UBIGINT END AS n FROM orders"
_BY_NAME = "SELECT row_number() OVER (ORDER BY c_name, c_acctbal, c_custkey) AS pos, c_name AS line FROM customer"
_QUOTED = "SELECT n_nationkey AS k, n_regionkey AS r, 'O''' || n_name || ', \"the\" ' || n_nationkey AS name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation"
_HEADED = "SELECT c_name AS line, row_number() OVER (ORDER BY c_name, c_acctbal, c_custkey) AS n, count(*) OVER () AS all_rows FROM customer"
_MIXED = "SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, c_custkey, c_acctbal FROM customer"
_XORSHIFT = """
WITH RECURSIVE s(i, x) AS (
  SELECT 0, 7::UHUGEINT
  UNION ALL
  SELECT i + 1, xor(c, c // 134217728::UHUGEINT) FROM (SELECT i, xor(b, (b * 33554432::UHUGEINT) % 18446744073709551616::UHUGEINT) AS c FROM (SELECT i, xor(x, x // 4096::UHUGEINT) AS b FROM s WHERE i < 200))
)
SELECT row_number() OVER (ORDER BY n) AS pos, CAST(n AS VARCHAR) AS number FROM (SELECT (x * 2685821657736338717::UHUGEINT) % 18446744073709551616::UHUGEINT AS n FROM s WHERE i > 0)
"""
ORACLES: dict[str, str] = {
    "file_u64": f"SELECT row_number() OVER (ORDER BY n) AS pos, CAST(n AS VARCHAR) AS number FROM ({_NUMBERS})",
    "file_u64_unique_top": f"SELECT row_number() OVER (ORDER BY n DESC) AS pos, CAST(n AS VARCHAR) AS number FROM (SELECT DISTINCT n FROM ({_NUMBERS})) ORDER BY n DESC LIMIT 100",
    "file_lines": _BY_NAME,
    "file_csv_detected": "SELECT CAST(1 AS BIGINT) AS pos, 'name;nation;segment' AS line UNION ALL SELECT 1 + row_number() OVER (ORDER BY c_nationkey, c_custkey), concat_ws(';', c_name, c_nationkey, c_mktsegment) FROM customer",
    "file_jsonl": """SELECT row_number() OVER (ORDER BY user_id DESC, event_id) AS pos, '{"id":' || event_id || ',"user":{"age":"' || user_id || '"}}' AS line FROM events""",
    "file_gzip": _BY_NAME,
    "file_zip": _BY_NAME,
    "file_encodings": "SELECT e.r AS read, e.w AS written, CASE WHEN e.w = 'latin-1' THEN 'no' ELSE 'yes' END AS marked, row_number() OVER (PARTITION BY e.r, e.w ORDER BY n_name || ' é' || n_nationkey) AS pos, n_name || ' é' || n_nationkey AS line FROM nation, (VALUES "
    + ", ".join(f"('{e}', '{e}')" for e in ENCODINGS) + ", ('utf-16le', 'latin-1')) AS e(r, w)",
    "file_excel": "SELECT CAST(1 AS BIGINT) AS pos, 'id,\"name, of nation\",code' AS line UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_name DESC, '0' || n_regionkey, n_nationkey), n_nationkey || ',' || n_name || ',0' || n_regionkey FROM nation",
    "file_merge": "SELECT row_number() OVER (ORDER BY o_orderpriority) AS pos, o_orderpriority AS line FROM orders",
    "file_to_csv": f"""SELECT CAST(1 AS BIGINT) AS pos, 'id,name,region' AS line UNION ALL SELECT pos + 1, k || ',"' || replace(name, '"', '""') || '",' || r FROM ({_QUOTED})""",
    "file_to_tsv": f"""SELECT CAST(1 AS BIGINT) AS pos, 'id' || chr(9) || 'name' || chr(9) || 'region' AS line UNION ALL SELECT pos + 1, k || chr(9) || '"' || replace(name, '"', '""') || '"' || chr(9) || r FROM ({_QUOTED})""",
    "file_to_jsonl": f"""SELECT pos, '{{"id":"' || k || '","name":"' || replace(name, '"', '\\"') || '","region":"' || r || '"}}' AS line FROM ({_QUOTED})""",
    "file_to_sql": f"""SELECT pos, 'INSERT INTO "nations" ("id","name","region") VALUES (''' || k || ''',''' || replace(name, '''', '''''') || ''',''' || r || ''');' AS line FROM ({_QUOTED})""",
    "file_split_number": f"WITH h AS ({_HEADED}), p AS (SELECT line, (n - 1) // ((all_rows + 3) // 4) + 1 AS part, n FROM h) SELECT printf('out-%03d.txt', part) AS file, 1 + row_number() OVER (PARTITION BY part ORDER BY n) AS pos, line FROM p UNION ALL SELECT DISTINCT printf('out-%03d.txt', part), CAST(1 AS BIGINT), 'c_name' FROM p",
    "file_split_size": f"""
WITH RECURSIVE h AS ({_HEADED}), c AS (SELECT line, n, CAST(sum(strlen(line) + 1) OVER (ORDER BY n) AS BIGINT) AS upto, strlen(line) + 1 AS size FROM h),
w(part, first, base) AS (
  SELECT 1, CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT part + 1, n, upto - size FROM (SELECT w.part, c.n, c.upto, c.size, row_number() OVER (ORDER BY c.n) AS k FROM w JOIN c ON c.n > w.first AND c.upto - w.base > 8192 - 7) WHERE k = 1
), p AS (SELECT c.line, c.n, (SELECT max(part) FROM w WHERE w.first <= c.n) AS part FROM c)
SELECT printf('out-%03d.txt', part) AS file, 1 + row_number() OVER (PARTITION BY part ORDER BY n) AS pos, line FROM p UNION ALL SELECT DISTINCT printf('out-%03d.txt', part), CAST(1 AS BIGINT), 'c_name' FROM p""",
    "file_folder": _BY_NAME,
    "file_resume": "SELECT row_number() OVER (ORDER BY c_name, c_acctbal, c_custkey) AS pos, c_name || '*' AS line FROM customer",
    "file_unique_ignore_case": f"SELECT row_number() OVER (ORDER BY lower(segment)) AS pos, segment AS line FROM (SELECT arg_min(segment, c_custkey) AS segment FROM ({_MIXED}) GROUP BY lower(segment))",
    "file_dedupe_ignore_case": f"SELECT row_number() OVER (ORDER BY c_custkey) AS pos, segment || ',' || c_custkey AS line FROM (SELECT arg_min(segment, c_custkey) AS segment, min(c_custkey) AS c_custkey FROM ({_MIXED}) GROUP BY lower(segment))",
    "file_date_key": "SELECT row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS pos, o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders",
    "file_report": "SELECT CAST(0 AS BIGINT) AS run, 'ok' AS status, count(*) AS rows_in, count(DISTINCT o_orderpriority) AS rows_out, count(*) - count(DISTINCT o_orderpriority) AS dupes_removed, true AS verified, CAST(0 AS BIGINT) AS exit_code, CAST(268435456 AS BIGINT) AS mem_limit_bytes FROM orders UNION ALL SELECT 1, 'error', NULL, NULL, NULL, NULL, 2, NULL",
    "file_check": """
WITH l AS (SELECT n_nationkey AS k, n_nationkey || '|' || n_name || '|' || n_regionkey AS line FROM nation), s AS (SELECT CAST(15 + sum(strlen(line) + 1) AS BIGINT) AS size, count(*) FILTER (WHERE k % 4 = 0) AS bad FROM l)
SELECT 'sound' AS name, size AS size_bytes, '|' AS delimiter, 'yes' AS header, CAST(3 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS bad_rows, 'ok' AS key, 'ready' AS status FROM s
UNION ALL SELECT 'ragged', size + 5 * bad, '|', 'yes', 3, bad, 'ok', 'not ready' FROM s UNION ALL SELECT 'no number', size, '|', 'yes', 3, 0, 'not numeric', 'not ready' FROM s""",
    "file_estimate": "SELECT CAST(13 * count(*) AS BIGINT) AS size_bytes, count(*) AS est_rows, (13 * count(*) + 4095) // 4096 AS splits, CAST(round(13 * count(*) * 2.15) AS BIGINT) AS temp_bytes, greatest(2.0, 13 * count(*) / 1048576.0 / 120 * 60 / sqrt(8))::DOUBLE AS seconds FROM orders",
    "file_inspect": "SELECT * FROM (VALUES ('a.csv', 'csv', ';', true, 'id,name'), ('b.tsv', 'csv', chr(9), false, 'col0,col1'), ('c.txt', 'string', '', false, ''), ('d.jsonl', 'jsonl', '', false, ''), ('e.bin', 'numeric', '', false, '')) AS t(file, format, delimiter, header, columns)",
    "file_preview": "SELECT 'head' AS side, row_number() OVER (ORDER BY n_nationkey) AS at, n_name AS line FROM (FROM nation ORDER BY n_nationkey LIMIT 15) UNION ALL SELECT 'tail', row_number() OVER (ORDER BY n_nationkey), n_name FROM (FROM nation ORDER BY n_nationkey DESC LIMIT 15)",
    "text_values": """
SELECT s_suppkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END AS size,
  format('{:,}', n) AS grouped, s_suppkey * 1024 + 512 AS parsed, CASE WHEN length(s_name) > 8 THEN left(s_name, 8) || '...' ELSE s_name END AS short
FROM (SELECT s_suppkey, s_name, s_suppkey * s_suppkey * s_suppkey * s_suppkey * s_suppkey AS n FROM supplier ORDER BY s_suppkey LIMIT 100)""",
    "made_numbers": _XORSHIFT,
    "exit_codes": "SELECT name, CAST(code AS BIGINT) AS exit_code FROM (VALUES ('sound', 0), ('output exists', 2), ('same file', 2), ('no input', 3), ('torn numbers', 5), ('unsorted merge', 6), ('directions', 2), ('zstd', 2)) AS t(name, code)",
    "service_sort": _BY_NAME,
}
