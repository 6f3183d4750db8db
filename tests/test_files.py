"""Hostile records, limits, layouts and the command line; and all file queries against their SQL."""

from __future__ import annotations

import glob
import json
import os
import random
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix import runs
from collatrix.budget import PeakMemory, budget, settings
from collatrix.cli import main
from collatrix.engine import run
from collatrix.errors import PreflightError, UsageError
from collatrix.functions.encoding import decode, decoded_blocks, encode, mark_of
from collatrix.functions.keys import fields, redelimit
from collatrix.generate import write_fixture, xorshift
from collatrix.operators.split import _walk
from collatrix.plans import files
from collatrix.sources.sample import split_quoted
from collatrix.sources.scan import decoded_lines, physical_lines
from collatrix.sources.xlsx import read_sheet
from collatrix.spec import SortSpec
from collatrix.staging import scope, stage
from collatrix.streaming.watch import watch


def test_quoted_fields_follow_the_state_machine(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice('ab",;￾￹￺') for _ in range(rng.randint(0, 14))) for _ in range(500)]
    lines = [x if x.count('"') % 2 == 0 else x + '"' for x in lines] + ["", '""', '""""', 'a,"",b', '"a,""b""",c']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = df.select("value", fields(F.col("value"), ",", True).alias("f"), redelimit(F.col("value"), ",", "\t").alias("t")).collect()
    for r in got:
        assert r.f == split_quoted(r.value, ","), r.value
        inside, out = False, []
        for ch in r.value:
            inside ^= ch == '"'
            out.append("\t" if ch == "," and not inside else ch)
        assert r.t == "".join(out)


def test_wide_quoted_records(spark, tmp_path):
    """A hundred thousand quoted fields, through TSV, JSON lines and SQL, in linear time."""
    source = tmp_path / "wide.csv"
    source.write_text(",".join(f'"f,{i}"' for i in range(100_000)) + "\n")
    began = time.time()
    for kind in ("tsv", "jsonl", "sql"):
        run(spark, SortSpec(input=str(source), output=str(tmp_path / kind), format="csv", keys=(0,), header=False, delimiter=",", quoted_keys=True, output_format=kind))
    assert (tmp_path / "tsv").read_text().count("\t") == 99_999
    assert len(json.loads((tmp_path / "jsonl").read_text())) == 100_000
    assert time.time() - began < 120


def test_part_starts():
    import pyarrow as pa

    rng = random.Random(5)
    for most in (10, 37, 1000):
        sizes = [rng.randint(1, 15) for _ in range(300)]
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a + 1, min(a + 41, 300) + 1)), pa.array(sizes[a : a + 41])], names=["pos", "size"]) for a in range(0, 300, 41)]
        got = [(p, x) for b in _walk(most)(iter(batches)) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        expected, part, room = [], 0, -1
        for i, size in enumerate(sizes, 1):
            if room < size:
                part += 1
                expected.append((part, i))
                room = most
            room -= size
        assert got == expected


def test_decoding_in_blocks():
    text = "é\r\n\n日本\na"
    for name in ("utf-8", "utf-8-bom", "utf-16le", "utf-16be", "utf-32le", "utf-32be"):
        raw = mark_of(name) + encode(text, name)
        for size in (1, 3, 1000):
            lines = list(decoded_blocks((raw[i : i + size] for i in range(0, len(raw), size)), name))
            assert lines == [x.removesuffix("\r") for x in decode(raw, name).split("\n")]
    assert list(decoded_blocks(iter([]), "utf-16le")) == []


def test_numbers_from_file_to_file(spark, tmp_path):
    values = np.random.default_rng(3).integers(0, 1 << 64, 100_001, dtype=np.uint64)
    values.tofile(tmp_path / "in")
    report = run(spark, SortSpec(input=str(tmp_path / "in"), output=str(tmp_path / "out"), verify=True))
    assert (np.fromfile(tmp_path / "out", np.uint64) == np.sort(values)).all() and report["rows_out"] == 100_001
    run(spark, SortSpec(input=str(tmp_path / "in"), output=str(tmp_path / "top"), limit=7, reverse=True, verify=True))
    assert (np.fromfile(tmp_path / "top", np.uint64) == np.sort(values)[::-1][:7]).all()
    (tmp_path / "none").write_bytes(b"")
    run(spark, SortSpec(input=str(tmp_path / "none"), output=str(tmp_path / "o")))
    assert (tmp_path / "o").read_bytes() == b""


def test_memory_and_threads(spark, tmp_path, monkeypatch):
    spec = SortSpec(input=str(tmp_path / "x"), output="-", format="string", max_memory="64MB", threads=2)
    asked = settings(spec, 1 << 30, 8)
    assert int(asked["spark.sql.files.maxPartitionBytes"]) * 2 * 8 <= 64 << 20 and int(asked["spark.sql.shuffle.partitions"]) == 256
    (tmp_path / "x").write_text("b\na\n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with budget(spark, spec):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == asked["spark.sql.files.maxPartitionBytes"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setenv("COLLATRIX_MAX_MEMORY", "32MB")
    assert settings(SortSpec(input="-", output="-", format="string"), 1, 4)
    for wrong in ({"max_memory": "1MB"}, {"threads": 0}, {"output_layout": "tape"}, {"output_layout": "folder", "split_by": 2}):
        with pytest.raises(UsageError):
            SortSpec(input="a", output="b", format="string", **wrong)
    with PeakMemory() as peak:
        pass
    assert peak.bytes > 0


def test_preflight(spark, tmp_path, monkeypatch):
    from collatrix.sources import sample

    (tmp_path / "x").write_text("b\na\n")
    monkeypatch.setattr(sample.shutil, "disk_usage", lambda _: type("U", (), {"free": 3})())
    with pytest.raises(PreflightError):
        run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / "y"), format="string"))


def test_fixture_stream(tmp_path):
    draw = xorshift(0)
    assert [next(draw) for _ in range(2)] == [next(x) for x in [xorshift(1)] for _ in range(2)]
    for kind in ("numeric", "string", "csv"):
        write_fixture(str(tmp_path / kind), 50, kind, 9, kind == "csv")
    assert list(struct.unpack("<50Q", (tmp_path / "numeric").read_bytes())) == [next(x) for x in [xorshift(9)] for _ in range(50)]
    rows = (tmp_path / "csv").read_text().splitlines()
    assert rows[0] == "id,idx,city,name" and len(rows) == 51 and all(2 <= len(r.split(",")[3]) <= 12 for r in rows[1:])
    assert main(["gen", str(tmp_path / "g"), "5", "tree"]) == 2 and main(["gen"]) == 2 and main(["gen", str(tmp_path / "g"), "5", "string", "1", "header"]) == 2


def test_runs_are_listed(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv(runs.TEMP_ENV, str(tmp_path / "runs"))
    (tmp_path / "x").write_text("b\n")
    runs.start(SortSpec(input=str(tmp_path / "x"), output="o", format="string"), str(tmp_path / "x"))
    assert main(["--resume", "list"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found) == 1 and found[0]["staged"] is False and found[0]["output"] == "o"


def test_staged_tables_of_a_run_go(spark):
    with scope() as block:
        with scope():
            path = stage(spark.range(3), "inner").inputFiles()[0]
        assert not os.path.exists(path.removeprefix("file://"))
        one, two = stage(spark.range(5), "one"), stage(spark.range(6), "two")
        block.drop(keep=[two])
        assert two.count() == 6 and not os.path.exists(one.inputFiles()[0].removeprefix("file://"))
    assert not os.path.exists(two.inputFiles()[0].removeprefix("file://"))


def test_parts_are_read_in_few_jobs(spark, tmp_path):
    """As many jobs for three hundred files as for three; positions start anew in each file."""
    made = {f"out-{i:03d}.txt": [f"{i} {j}" for j in range(i % 7 + 1)] for i in range(1, 301)}
    for name, lines in made.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    paths, tracker, jobs = [str(tmp_path / name) for name in made], spark.sparkContext.statusTracker(), []
    for some in (paths[:3], paths):
        spark.sparkContext.setJobGroup(f"parts of {len(some)}", "")
        try:
            found = files._lines_of_files(spark, some).collect()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        jobs.append(len(tracker.getJobIdsForGroup(f"parts of {len(some)}")))
    assert sorted((r.file, r.pos, r.line) for r in found) == [(name, i, x) for name, lines in made.items() for i, x in enumerate(lines, 1)]
    assert jobs[1] <= jobs[0] + 2


@pytest.fixture
def far_tasks(monkeypatch):
    """The engine takes the session for one whose tasks run on other machines."""
    from collatrix import engine

    monkeypatch.setattr(engine, "local_master", lambda _: False)


def test_other_encodings_on_a_cluster(spark, tmp_path, far_tasks):
    (tmp_path / "x").write_text("é\na\n")
    for encoding in ("utf-8-bom", "utf-16le", "latin-1"):
        run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / encoding), format="string", encoding_out=encoding))
        assert (tmp_path / encoding).read_bytes() == mark_of(encoding) + encode("a\né\n", encoding)
    run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / "folder"), format="string"))
    assert (tmp_path / "folder").is_dir()
    with pytest.raises(UsageError):
        run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / "f"), format="string", encoding_out="latin-1", output_layout="folder"))


def test_spreadsheets_on_a_cluster(spark, tmp_path, far_tasks):
    (tmp_path / "x").write_text("b,1\na,2\n")
    run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / "o.xlsx"), format="csv", keys=(0,), header=False, delimiter=","))
    assert list(read_sheet((tmp_path / "o.xlsx").read_bytes())) == [["a", "2"], ["b", "1"]]
    with pytest.raises(UsageError):
        run(spark, SortSpec(input=str(tmp_path / "x"), output=str(tmp_path / "p.xlsx"), format="string", output_layout="folder"))


def test_zip_on_a_cluster(spark, tmp_path, far_tasks):
    """Line counts at and beside whole blocks of 10,000, and none."""
    for many in (0, 9_999, 10_000, 20_000, 20_001):
        lines = [f"{i:05d}\n" for i in range(many)]
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            z.writestr("x", "".join(reversed(lines)))
        run(spark, SortSpec(input=str(tmp_path / "x.zip"), output=str(tmp_path / "o.zip"), format="string", verify=True, force=True))
        with zipfile.ZipFile(tmp_path / "o.zip") as z:
            assert [z.read(n).decode() for n in z.namelist()] == ["".join(lines)]
        (tmp_path / "x.txt").write_bytes(mark_of("utf-16le") + encode("".join(lines), "utf-16le"))
        assert decoded_lines(spark, str(tmp_path / "x.txt"), "utf-16le").count() == many


@pytest.fixture
def small_ranges(spark):
    """Sorted tables have as many ranges as there are shuffle partitions, so folders have many parts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_files_of_a_folder_follow_by_name(spark, tmp_path):
    folder = tmp_path / "a b"  # names are URL-encoded in places
    folder.mkdir()
    lines = [[f"{i} {j}" for j in range(many)] for i, many in enumerate((1, 900, 3, 5000, 0, 40))]
    for i, some in enumerate(lines):
        (folder / f"part-{i}é.txt").write_text("".join(x + "\r\n" for x in some))
    rows = physical_lines(spark, str(folder), 7).orderBy("_rid").collect()
    assert [r.value for r in rows] == [x for some in lines for x in some] and rows[0]._rid.file == 7
    rows = physical_lines(spark, str(folder / "part-1é.txt"), 7).orderBy("_rid").collect()
    assert [r.value for r in rows] == lines[1] and {r._rid.file for r in rows} == {7}


def test_delimited_file_on_a_cluster(spark, far_tasks, small_ranges):
    found = [r.line for r in files.file_csv_detected(spark, "/root/testdata/sf0.01").orderBy("pos").collect()]
    assert found[0] == "name;nation;segment" and found[1:] == sorted(found[1:], key=lambda x: (int(x.split(";")[1]), x))


@pytest.mark.parametrize("name", sorted(files.ORACLES))
def test_file_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    found = files.QUERIES[name](spark, sf)
    expected = con.execute(files.ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(d[0] for d in expected.description)
    places = [[d[0] for d in expected.description].index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["file_date_key", "file_gzip", "file_lines", "file_merge", "file_resume"])
def test_file_queries_on_a_cluster(spark, far_tasks, small_ranges, name):
    """Folders of several parts, read in order."""
    test_file_queries(spark, name)


def test_json_lines_on_a_cluster(spark, far_tasks, small_ranges):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = [json.loads(r.line) for r in files.file_jsonl(spark, "/root/testdata/sf0.01").orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 10_000 and found == sorted(found, key=lambda x: (-int(x["user"]["age"]), x["id"]))


def test_watched_folder_on_a_cluster(spark, tmp_path, far_tasks):
    """One sorted file for each file that arrives, where the tasks run on other machines, too."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("b\na\n")
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), SortSpec(input="-", output="-", format="string"), str(tmp_path / "state"), existing=True).awaitTermination()
    assert (tmp_path / "out" / "sorted-x.txt").read_text() == "a\nb\n"
