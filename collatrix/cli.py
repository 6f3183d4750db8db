"""Command line: ``python -m collatrix.cli --input F --output G --format csv --keys 0,2 ...``, and
``python -m collatrix.cli gen OUT ROWS numeric|string|csv [SEED] [header]``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from collatrix import runs
from collatrix.budget import memory_limit
from collatrix.engine import run
from collatrix.errors import EngineError, UsageError
from collatrix.functions.values import grouped, human_size
from collatrix.generate import SEED, write_fixture
from collatrix.sources.sample import check, estimate
from collatrix.spec import SortSpec

#: Options of the command that aren't those of a run.
_ASIDE = ("check", "dry_run", "stats", "stats_json", "json", "watch", "output_dir", "checkpoint", "existing", "temp_dir", "quiet")


def _columns(text: str) -> tuple[int, ...]:
    try:
        return tuple(int(x) for x in text.split(","))
    except ValueError:
        raise UsageError(f"not columns: {text!r}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("collatrix")
    for name in ("input", "output", "key-field", "delimiter", "sql-table", "encoding-in", "encoding-out", "sheet", "split-by-size", "log-file", "max-memory", "output-layout"):
        p.add_argument(f"--{name}")
    p.add_argument("--encoding", help="both encoding-in and encoding-out")
    p.add_argument("--format", "--mode", default="numeric")
    p.add_argument("--keys", "--multi-key", "--key-column", type=_columns, default=())
    p.add_argument("--key-type", default="string")
    p.add_argument("--key-dir", type=lambda s: tuple(s.split(",")), default=())
    p.add_argument("--dedupe-by", type=_columns, default=())
    p.add_argument("--dedupe-keep", default="first")
    p.add_argument("--nulls", default="first")
    p.add_argument("--output-format")
    p.add_argument("--merge", nargs="+", default=())
    p.add_argument("--preview", type=int, nargs="?", const=20)
    for name in ("limit", "split-by", "threads"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--header", action=argparse.BooleanOptionalAction, default=None)
    for name in ("reverse", "ignore-case", "unique", "distinct", "verify", "force", "backup", "preserve-key-order", "quoted-keys"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--resume", nargs="?", const="run", choices=("run", "list"), help="take up an unfinished run, or list them")
    p.add_argument("--watch", metavar="DIR", help="sort each new file of a folder to --output-dir")
    for name in ("output-dir", "checkpoint", "temp-dir"):
        p.add_argument(f"--{name}")
    for name in ("check", "dry-run", "stats", "stats-json", "json", "existing", "quiet"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def session(spec: SortSpec) -> SparkSession:
    """The active session, or one with the memory and threads that were asked for."""
    builder = SparkSession.builder.appName("collatrix")
    if SparkSession.getActiveSession() is None and not os.environ.get("SPARK_REMOTE"):
        if spec.threads is not None:
            builder = builder.master(f"local[{spec.threads}]")
        if (limit := memory_limit(spec)) is not None:
            builder = builder.config("spark.driver.memory", f"{max(512, limit >> 20)}m")
    return builder.getOrCreate()


def _stats(report: dict) -> str:
    lines = [("rows in", grouped(report["rows_in"])), ("rows out", grouped(report["rows_out"])), ("duplicates removed", grouped(report["dupes_removed"])), ("seconds", f"{report['timing']['total_s']:.2f}")]
    lines += [("peak memory", human_size(report["peak_ram_bytes"])), ("MB a minute", f"{report['throughput_mb_per_min']:.1f}"), ("verified", "yes" if report["verified"] else "no")]
    return "\n".join(f"{name:>20}  {value}" for name, value in lines)


def generate_file(args: list[str]) -> int:
    if not 3 <= len(args) <= 5 or (len(args) == 5 and args[4] != "header"):
        raise UsageError("gen OUT ROWS numeric|string|csv [SEED] [header]")
    try:
        rows, seed = int(args[1]), int(args[3]) if len(args) > 3 else SEED
    except ValueError:
        raise UsageError("rows and seed are whole numbers") from None
    if rows < 0 or not 0 <= seed < 1 << 64:
        raise UsageError("rows and seed aren't negative")
    write_fixture(args[0], rows, args[2], seed, len(args) == 5)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    try:
        if args[:1] == ["gen"]:
            return generate_file(args[1:])
        given = vars(parser().parse_args(args))
        aside = {name: given.pop(name) for name in _ASIDE}
        if aside["temp_dir"]:
            os.environ[runs.TEMP_ENV] = aside["temp_dir"]
        if given["resume"] == "list":
            print(json.dumps(runs.listing()))
            return 0
        given["resume"] = given["resume"] == "run"
        both = given.pop("encoding")
        given["encoding_in"], given["encoding_out"] = given["encoding_in"] or both, given["encoding_out"] or both
        given["merge"] = tuple(given["merge"])
        given["sql_table"] = given["sql_table"] or "data"
        spec = SortSpec(**given)
        if aside["check"]:
            report = check(spec.input, spec)
            print(json.dumps(report))
            return 0 if report["status"] == "ready" else 5
        if aside["dry_run"]:
            print(json.dumps(estimate(spec.input, spec, threads=spec.threads or 8)))
            return 0
        spark = spark or session(spec)
        if aside["watch"]:
            from collatrix.streaming.watch import watch

            out = aside["output_dir"] or os.path.join(aside["watch"], "sorted")
            query = watch(spark, aside["watch"], out, spec.with_(input="-", output="-"), aside["checkpoint"] or os.path.join(out, ".checkpoint"), aside["existing"], once=False, log_file=spec.log_file)
            query.awaitTermination()
            return 0
        report = run(spark, spec)
        if aside["stats"] and "rows_in" in report:
            print(_stats(report), file=sys.stderr)
        if not aside["quiet"] or aside["json"] or aside["stats_json"]:
            print(json.dumps(report))
    except EngineError as e:
        print(json.dumps({"status": "error", "exit_code": e.code, "error": str(e)}), file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
