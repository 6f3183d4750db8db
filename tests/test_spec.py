from __future__ import annotations

import pytest

from collatrix.errors import UsageError
from collatrix.functions.encoding import canonical, sniff
from collatrix.functions.values import grouped, human_size, parse_size, shorten
from collatrix.sources.sample import check, detect_delimiter, detect_header, estimate, file_preview, inspect, split_quoted
from collatrix.spec import SortSpec, parse_delimiter

BASE = {"input": "i", "output": "o"}


@pytest.mark.parametrize("options", [
    {"format": "xml"}, {"format": "csv"}, {"keys": (0,)}, {"format": "csv", "keys": (0, 1, 2, 3, 4)}, {"format": "csv", "keys": (-1,)},
    {"format": "csv", "keys": (0, 1), "key_dir": ("asc",)}, {"format": "csv", "keys": (0,), "key_dir": ("up",)}, {"format": "string", "key_dir": ("asc",)},
    {"format": "jsonl"}, {"key_field": "a"}, {"format": "string", "dedupe_by": (0,)}, {"limit": 0}, {"preview": 0}, {"split_by": 1}, {"split_by_size": "1"},
    {"split_by": 2, "split_by_size": "1mb"}, {"split_by": 2, "preview": 2}, {"header": True}, {"merge": ("a",)}, {"output_format": "sql"},
    {"format": "csv", "keys": (0,), "output_format": "pdf"}, {"nulls": "x"}, {"dedupe_keep": "x"}, {"encoding_in": "ebcdic"}, {"input": "a.zst"},
    {"format": "string", "output": "o.xlsx"}, {"format": "csv", "keys": (0,), "delimiter": "ab"}, {"output": "o.gz", "split_by": 2},
])
def test_refused(options):
    with pytest.raises(UsageError) as e:
        SortSpec(**(BASE | options))
    assert e.value.code == 2


def test_key_order():
    assert SortSpec(**BASE, format="csv", keys=(2, 0, 2)).keys == (0, 2)
    assert SortSpec(**BASE, format="csv", keys=(2, 0), preserve_key_order=True).keys == (2, 0)


def test_values():
    assert [parse_size(x) for x in ("1", "1k", "1.5gb", "2 MB", 7)] == [1, 1024, 1610612736, 2 << 20, 7]
    for bad in ("", "x", "1q", "99999999999999tb"):
        with pytest.raises(UsageError):
            parse_size(bad)
    assert (human_size(5), human_size(1536), grouped(1234567)) == ("5 B", "1.5 KB", "1,234,567")
    assert shorten("é" * 10, 5) == "éé..." and shorten("abc") == "abc"
    assert [parse_delimiter(x) for x in ("\\t", "tab", "\\s", ";")] == ["\t", "\t", " ", ";"]
    assert canonical("Windows-1252") == "latin-1" and sniff(b"\xff\xfe\0\0x") == "utf-32le" and sniff(b"\xff\xfex") == "utf-16le" and sniff(b"x") is None


def test_sampling(tmp_path):
    assert detect_delimiter(["a;b;c", "1;2;3", '"x;y";2;3']) == ";"
    assert detect_delimiter(["plain", "text"]) == ","
    assert detect_header(["id,v", "1,2", "2,3", "3,4"], 0, ",", True) and not detect_header(["1,v", "1,2", "2,3", "3,4"], 0, ",", True)
    assert detect_header(["full name,v", "x,y"], 0, ",", False)
    assert split_quoted('a,"b,""c",d', ",") == ["a", 'b,"c', "d"]
    f = tmp_path / "x.csv"
    f.write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(50)))
    report = check(str(f), SortSpec(**BASE, format="csv", keys=(0,), key_type="numeric"))
    assert (report["status"], report["delimiter"], report["header"], report["columns"], report["bad_rows"]) == ("ready", ",", "yes", 2, 0)
    assert check(str(f), SortSpec(**BASE, format="csv", keys=(1,), key_type="numeric"))["status"] == "not ready"
    assert inspect(str(f))["columns"] == ["id", "name"]
    assert estimate(str(f), SortSpec(**BASE, format="csv", keys=(0,)))["seconds"] >= 2
    assert file_preview(str(f), 2)["head"] == ["id,name", "0,n0"]
    b = tmp_path / "b.bin"
    b.write_bytes(b"abc")
    assert check(str(b), SortSpec(**BASE))["status"] == "not ready"
