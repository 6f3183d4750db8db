"""The HTTP service, generator, command line and entry module."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request

import pytest

from collatrix.api import serve
from collatrix.cli import main
from collatrix.generate import generate


@pytest.fixture
def call(spark, tmp_path):
    server = serve(spark, str(tmp_path), token="secret")

    def ask(path, body=None, token="secret"):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request) as r:
                raw = r.read()
                return r.status, json.loads(raw) if "json" in r.headers["Content-Type"] else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield ask
    server.shutdown()


def test_jobs(call, tmp_path):
    assert call("/api/health", token="x")[0] == 200
    assert {call(p, token="x")[0] for p in ("/api/jobs", "/api/history", "/api/status", "/metrics", "/api/job?id=1")} == {401}
    assert call("/api/upload?filename=../a.csv", b"id,v\n2,b\n1,a\n")[1]["path"] == "uploads/a.csv"
    assert call("/api/inspect?path=uploads/a.csv")[1]["columns"] == ["id", "v"]
    assert call("/api/preview?path=uploads/a.csv&n=1")[1]["head"] == ["id,v"]
    assert call("/api/preview?path=../../etc/passwd")[0] == 403
    asked = {"input": "uploads/a.csv", "output": "out.csv", "format": "csv", "key_column": 0, "key_type": "numeric", "header": True, "verify": True}
    status, job = call("/api/sort", asked)
    assert status == 202
    for _ in range(600):
        found = call(f"/api/job/{job['id']}")[1]
        if found["status"] not in ("queued", "running"):
            break
        time.sleep(0.1)
    assert found["status"] == "done", found
    assert call(f"/api/job/{job['id']}/result")[1] == b"id,v\n1,a\n2,b\n" == call("/download?path=out.csv")[1]
    assert [h["id"] for h in call("/api/history")[1]] == [job["id"]]
    assert call("/api/sort", asked | {"format": "xml"})[0] == 400 and call("/api/sort", {})[0] == 400
    assert call("/api/rerun", {"id": "0"})[0] == 404 and call("/api/cancel", {"id": job["id"]})[1]["status"] == "done"
    assert b"collatrix_jobs" in call("/metrics-prom")[1] and call("/metrics")[1]["jobs"]["done"] == 1
    assert call("/api/gen?rows=5&mode=csv&name=g.csv")[1]["rows"] == 5
    assert (tmp_path / "g.csv").read_text().splitlines()[0] == "id,idx,city,name"
    assert call("/api/history/clear", {})[0] == 200 and call("/api/history")[1] == []
    assert "out.csv" in {f["name"] for f in call("/api/files")[1]} and call("/none")[0] == 404


def test_results_on_a_cluster(call, monkeypatch):
    """A result can be downloaded where the tasks run on other machines, too."""
    from collatrix import engine

    monkeypatch.setattr(engine, "local_master", lambda _: False)
    name = call("/api/upload?filename=x.txt", b"b\nc\na\n")[1]["path"]
    job = call("/api/sort", {"input": name, "output": "out.txt", "format": "string", "verify": True})[1]["id"]
    while (status := call(f"/api/job/{job}")[1]["status"]) in ("queued", "running"):
        time.sleep(0.1)
    assert status == "done" and call(f"/api/job/{job}/result") == (200, b"a\nb\nc\n")


def test_generator(spark):
    for kind in ("numeric", "string", "csv"):
        one = [bytes(r.value) if kind == "numeric" else r.value for r in generate(spark, 50, kind, 3).orderBy("_rid").collect()]
        again = [bytes(r.value) if kind == "numeric" else r.value for r in generate(spark, 50, kind, 3).repartition(3).orderBy("_rid").collect()]
        assert one == again and len(set(one)) == 50
    assert all(len(x.split(",")) == 4 for x in one)


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "a.csv"
    f.write_text("3,c\n1,a\n")
    common = ["--input", str(f), "--format", "csv", "--keys", "0", "--key-type", "numeric", "--no-header"]
    assert main([*common, "--output", str(tmp_path / "o.csv")], spark) == 0 and (tmp_path / "o.csv").read_text() == "1,a\n3,c\n"
    assert main([*common, "--output", str(tmp_path / "o.csv")], spark) == 2
    assert main([*common, "--check"], spark) == 0 and main([*common, "--dry-run"], spark) == 0
    f.write_text("x,c\n")
    assert main([*common, "--output", str(tmp_path / "p.csv")], spark) == 5
    assert "exit_code" in capsys.readouterr().err


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 100
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len([n for n in names if not n.startswith("op")]) >= 29


@pytest.mark.parametrize("name", ["sort_u64_desc", "sort_nulls_last_reverse", "sort_json_field", "unique_adjacent", "dedupe_keep_last_runs", "preview_head_tail", "merge_unsorted_check", "convert_jsonl", "convert_sql", "multiline_records", "check_columns"])
def test_catalogue_against_sql(spark, name):
    import duckdb

    from collatrix.plans import catalogue

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "nation", "part", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"SELECT {columns} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
