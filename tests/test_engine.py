"""Golden cases of whole runs: files in, files out."""

from __future__ import annotations

import gzip
import random
import struct
import zipfile

import pytest

from collatrix.engine import run
from collatrix.errors import DataError, PreflightError, UsageError, VerifyError
from collatrix.spec import SortSpec


def sort_text(spark, tmp_path, text, **options):
    source, target = tmp_path / "in.txt", tmp_path / "out.txt"
    source.write_bytes(text if isinstance(text, bytes) else text.encode())
    report = run(spark, SortSpec(input=str(source), output=str(target), force=True, **options))
    assert report["exit_code"] == 0
    return target.read_bytes().decode()


CSV = {"format": "csv", "header": False, "delimiter": ","}

CASES = [
    ("banana\napple\ncherry\napple\ndate\n", {"format": "string"}, "apple\napple\nbanana\ncherry\ndate\n"),
    ("héllo\nwörld\n日本語\naaa\nzzz\nÁpple\n", {"format": "string"}, "aaa\nhéllo\nwörld\nzzz\nÁpple\n日本語\n"),
    ("pear\napple\norange", {"format": "string"}, "apple\norange\npear\n"),
    ("pear\r\napple\r\norange\r\n", {"format": "string"}, "apple\norange\npear\n"),
    ("b\n\na\n \n", {"format": "string"}, " \na\nb\n"),
    ("", {"format": "string"}, ""),
    ("a\nc\nb\n", {"format": "string", "reverse": True}, "c\nb\na\n"),
    ("b\na\nb\na\nc\n", {"format": "string", "unique": True}, "a\nb\nc\n"),
    ("d\nb\na\nc\n", {"format": "string", "limit": 2}, "a\nb\n"),
    ("b\nA\nc\n", {"format": "string", "ignore_case": True}, "A\nb\nc\n"),
    ("b\nB\nA\na\n", {"format": "string", "ignore_case": True, "unique": True}, "A\nb\n"),
    ("id,name\n30,b\n5,a\n20,c\n", {"format": "csv", "keys": (0,), "key_type": "numeric", "header": True}, "id,name\n5,a\n20,c\n30,b\n"),
    ("b,2\na,2\na,1\n", CSV | {"keys": (0, 1)}, "a,1\na,2\nb,2\n"),
    ("1,a\n1,z\n2,b\n", CSV | {"keys": (0,), "dedupe_by": (0,)}, "1,a\n2,b\n"),
    ("1,a\n1,z\n2,b\n", CSV | {"keys": (0,), "dedupe_by": (0,), "dedupe_keep": "last"}, "1,z\n2,b\n"),
    ("a,2\na,1\nb,1\n", CSV | {"keys": (0, 1), "key_dir": ("asc", "desc")}, "a,2\na,1\nb,1\n"),
    ("b,2\n,1\na,3\n", CSV | {"keys": (0,), "nulls": "last"}, "a,3\nb,2\n,1\n"),
    ("b,2\n,1\na,3\n", CSV | {"keys": (0,)}, ",1\na,3\nb,2\n"),
    ("b,2\n,1\na,3\n", CSV | {"keys": (0,), "nulls": "last", "reverse": True}, ",1\nb,2\na,3\n"),
    ("b,2\n,1\na,3\n", CSV | {"keys": (0,), "reverse": True}, "b,2\na,3\n,1\n"),
    ("1,x\n1,y\n1,x\n1,x\n", CSV | {"keys": (0,), "unique": True}, "1,x\n1,y\n1,x\n"),
    ("1,x\n1,y\n1,x\n1,x\n", CSV | {"keys": (0,), "distinct": True}, "1,x\n1,y\n"),
    ("x,1\ny,1\nx,1\n", CSV | {"keys": (1,), "reverse": True}, "x,1\ny,1\nx,1\n"),
    ("2,0\n1,1\n1,0\n", CSV | {"keys": (1, 0)}, "1,0\n1,1\n2,0\n"),
    ("2,0\n1,1\n1,0\n", CSV | {"keys": (1, 0), "preserve_key_order": True}, "1,0\n2,0\n1,1\n"),
    ('id,note\n2,"bar\nbaz"\n1,aaa\n', {"format": "csv", "keys": (0,), "key_type": "numeric", "header": True, "delimiter": ","}, 'id,note\n1,aaa\n2,"bar\nbaz"\n'),
    ('2,"a\n\nb""c\nd"\n1,x\n', CSV | {"keys": (0,)}, '1,x\n2,"a\n\nb""c\nd"\n'),
    ("18446744073709551615\n+7\n 0\n", CSV | {"keys": (0,), "key_type": "numeric"}, " 0\n+7\n18446744073709551615\n"),
    ('{"u":{"a":10}}\n{"u":{"a":"9"}}\n', {"format": "jsonl", "key_field": "u.a", "key_type": "numeric"}, '{"u":{"a":"9"}}\n{"u":{"a":10}}\n'),
    ('{"k":"b"}\n{"k":null}\n{"k":true}\n', {"format": "jsonl", "key_field": "k"}, '{"k":null}\n{"k":"b"}\n{"k":true}\n'),
]


@pytest.mark.parametrize(("text", "options", "expected"), CASES)
def test_golden(spark, tmp_path, text, options, expected):
    assert sort_text(spark, tmp_path, text, verify=True, **options) == expected


@pytest.mark.parametrize("text", ["x,1\n", "1.5,1\n", "-1,1\n", ",1\n", "18446744073709551616,1\n", "1e3,1\n"])
def test_bad_numbers(spark, tmp_path, text):
    with pytest.raises(DataError):
        sort_text(spark, tmp_path, text, **CSV, keys=(0,), key_type="numeric")


def test_missing_column_and_field(spark, tmp_path):
    with pytest.raises(DataError):
        sort_text(spark, tmp_path, "a,1\nb\n", **CSV, keys=(1,))
    for text in ('{"k":1}\n{"x":1}\n', '{"k":1}\nnot json\n'):
        with pytest.raises(DataError):
            sort_text(spark, tmp_path, text, format="jsonl", key_field="k")
    for text in ('{"k":1.5}\n', '{"k":-1}\n', '{"k":true}\n', '{"k":null}\n'):
        with pytest.raises(DataError):
            sort_text(spark, tmp_path, text, format="jsonl", key_field="k", key_type="numeric")


def test_numeric_binary(spark, tmp_path):
    rng = random.Random(3)
    values = [2**64 - 1, 0, 2**63, 42, 42, 1, *[rng.getrandbits(64) for _ in range(500)]]
    source, target = tmp_path / "n.bin", tmp_path / "o.bin"
    source.write_bytes(struct.pack(f"<{len(values)}Q", *values))
    read = lambda: list(struct.unpack(f"<{target.stat().st_size // 8}Q", target.read_bytes()))
    run(spark, SortSpec(input=str(source), output=str(target), verify=True))
    assert read() == sorted(values)
    run(spark, SortSpec(input=str(source), output=str(target), verify=True, force=True, unique=True, reverse=True))
    assert read() == sorted(set(values), reverse=True)
    source.write_bytes(source.read_bytes() + b"abc")
    with pytest.raises(DataError):
        run(spark, SortSpec(input=str(source), output=str(target), force=True))


def test_random_lines_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + f",{rng.randint(0, 30)}" for _ in range(4000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = sort_text(spark, tmp_path, "\n".join(lines), **CSV, keys=(1,), key_type="numeric", verify=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out.splitlines() == sorted(lines, key=lambda x: int(x.split(",")[1]))


def test_multiline_over_many_splits(spark, tmp_path):
    rng = random.Random(6)
    records = [f'{rng.randint(0, 999)},"' + "\n".join("x" * rng.randint(0, 9) for _ in range(rng.randint(1, 40))) + '"' for _ in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = sort_text(spark, tmp_path, "\n".join(records) + "\n", **CSV, keys=(0,), key_type="numeric")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out == "\n".join(sorted(records, key=lambda x: int(x.split(",")[0]))) + "\n"


def test_merge(spark, tmp_path):
    a, b, out = tmp_path / "a", tmp_path / "b", tmp_path / "o"
    a.write_text("a\nc\n")
    b.write_text("b\nd\n")
    run(spark, SortSpec(output=str(out), format="string", merge=(str(a), str(b)), verify=True))
    assert out.read_text() == "a\nb\nc\nd\n"
    assert a.exists() and b.exists()
    b.write_text("b\na\n")
    with pytest.raises(VerifyError) as e:
        run(spark, SortSpec(output=str(out), format="string", merge=(str(a), str(b)), verify=True, force=True))
    assert e.value.code == 6


@pytest.mark.parametrize("encoding", ["utf-8-bom", "latin-1", "utf-16le", "utf-16be", "utf-32le", "utf-32be"])
def test_encodings(spark, tmp_path, encoding):
    from collatrix.functions.encoding import encode, mark_of

    source, target = tmp_path / "e.txt", tmp_path / "f.txt"
    source.write_bytes(mark_of(encoding) + encode("é\nb\na\n", encoding))
    given = {"encoding_in": encoding} if encoding == "latin-1" else {}
    run(spark, SortSpec(input=str(source), output=str(target), format="string", **given))
    assert target.read_bytes() == mark_of(encoding) + encode("a\nb\né\n", encoding)
    run(spark, SortSpec(input=str(source), output=str(target), format="string", encoding_out="utf-8", force=True, **given))
    assert target.read_text() == "a\nb\né\n"


def test_compressed(spark, tmp_path):
    with gzip.open(tmp_path / "i.gz", "wt") as f:
        f.write("b\na\n")
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("one", "d\nc")
        z.writestr("two", "c\nb\n")
    run(spark, SortSpec(input=str(tmp_path / "i.gz"), output=str(tmp_path / "o.gz"), format="string"))
    assert gzip.open(tmp_path / "o.gz").read() == b"a\nb\n"
    run(spark, SortSpec(input=str(tmp_path / "i.zip"), output=str(tmp_path / "o.zip"), format="string"))
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.read(z.namelist()[0]) == b"b\ncc\nd\n"


def test_excel_round_trip(spark, tmp_path):
    from collatrix.sources.xlsx import read_sheet, write_sheet

    write_sheet(str(tmp_path / "i.xlsx"), [["id", "name"], ["30", "b,x"], ["5", "007"]], bold_first=True)
    run(spark, SortSpec(input=str(tmp_path / "i.xlsx"), output=str(tmp_path / "o.xlsx"), format="excel", keys=(0,), key_type="numeric", header=True))
    assert list(read_sheet((tmp_path / "o.xlsx").read_bytes())) == [["id", "name"], ["5", "007"], ["30", "b,x"]]


def test_conversions(spark, tmp_path):
    text = 'id;note\n2;"a;b"\n1;it\'s\n'
    options = {"format": "csv", "keys": (0,), "header": True, "delimiter": ";"}
    assert sort_text(spark, tmp_path, text, output_format="csv", **options) == 'id,note\n1,it\'s\n2,"a;b"\n'
    assert sort_text(spark, tmp_path, text, output_format="tsv", **options) == 'id\tnote\n1\tit\'s\n2\t"a;b"\n'
    assert sort_text(spark, tmp_path, text, output_format="jsonl", **options) == '{"id":"1","note":"it\'s"}\n{"id":"2","note":"a;b"}\n'
    out = sort_text(spark, tmp_path, text, output_format="sql", sql_table="t", **options)
    assert out == "INSERT INTO \"t\" (\"id\",\"note\") VALUES ('1','it''s');\nINSERT INTO \"t\" (\"id\",\"note\") VALUES ('2','a;b');\n"
    with pytest.raises(DataError):
        sort_text(spark, tmp_path, "1;2\n3\n", output_format="sql", **(options | {"header": False}))


def test_splits(spark, tmp_path):
    source = tmp_path / "s.txt"
    source.write_text("".join(f"row{i:04d}\n" for i in range(200, 0, -1)))
    report = run(spark, SortSpec(input=str(source), output=str(tmp_path / "p.txt"), format="string", split_by=3))
    parts = [open(p).read().splitlines() for p in report["files"]]
    assert [len(p) for p in parts] == [67, 67, 66] and sum(parts, []) == [f"row{i:04d}" for i in range(1, 201)]
    report = run(spark, SortSpec(input=str(source), output=str(tmp_path / "q.txt"), format="string", split_by_size="1KB"))
    parts = [open(p, "rb").read() for p in report["files"]]
    assert b"".join(parts) == "".join(f"row{i:04d}\n" for i in range(1, 201)).encode() and all(len(p) <= 1024 for p in parts)


def test_preview_backup_guards(spark, tmp_path):
    source, target = tmp_path / "a.txt", tmp_path / "b.txt"
    source.write_text("d\nb\na\nc\n")
    shown = run(spark, SortSpec(input=str(source), format="string", preview=3))
    assert (shown["total_rows"], shown["head"], shown["tail"]) == (4, ["a", "b", "c"], ["d"])
    target.write_text("OLD")
    with pytest.raises(UsageError):
        run(spark, SortSpec(input=str(source), output=str(target), format="string"))
    run(spark, SortSpec(input=str(source), output=str(target), format="string", backup=True))
    assert (tmp_path / "b.txt.bak").read_text() == "OLD" and target.read_text() == "a\nb\nc\nd\n"
    with pytest.raises(UsageError):
        run(spark, SortSpec(input=str(source), output=str(source), format="string", force=True))
    with pytest.raises(PreflightError):
        run(spark, SortSpec(input=str(tmp_path / "none"), output=str(target), format="string"))


def test_resume(spark, tmp_path, monkeypatch):
    from collatrix import engine, runs

    monkeypatch.setenv(runs.TEMP_ENV, str(tmp_path / "runs"))
    source, target = tmp_path / "a.txt", tmp_path / "b.txt"
    source.write_text("b\na\nb\n")
    spec = SortSpec(input=str(source), output=str(target), format="string", unique=True, resume=True)
    whole = engine.write_single
    monkeypatch.setattr(engine, "write_single", lambda *a, **k: (_ for _ in ()).throw(PreflightError("stopped")))
    with pytest.raises(PreflightError):
        run(spark, spec)
    assert len(runs.resumable()) == 1 and runs.resumable()[0].staged
    monkeypatch.setattr(engine, "write_single", whole)
    report = run(spark, spec)
    assert target.read_text() == "a\nb\n" and report["dupes_removed"] == 1 and not runs.resumable()


def test_watch(spark, tmp_path):
    from collatrix.streaming.watch import watch

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "old.txt").write_text("z\n")
    spec = SortSpec(input="-", output="-", format="string")
    again = lambda: watch(spark, str(folder), str(out), spec, str(tmp_path / "c"), log_file=str(tmp_path / "log")).awaitTermination()
    again()
    (folder / "one.txt").write_text("b\na\n")
    again()
    (folder / "two.txt").write_text("d\nc\n")
    again()
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["sorted-one.txt", "sorted-two.txt"]
    assert (out / "sorted-one.txt").read_text() == "a\nb\n"
    assert len((tmp_path / "log").read_text().splitlines()) == 2
