"""HTTP service over the engine: jobs, inspection, previews, history, metrics, upload and download.

A thin layer: each job is one engine run under a Spark job tag, so cancelling a job cancels its Spark
work. All routes but ``/`` and ``/api/health`` need the token if one is set, and all paths stay
inside the served folder.
"""

from __future__ import annotations

import hmac
import json
import os
import re
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from collatrix import __version__
from collatrix.budget import resident_bytes
from collatrix.engine import run
from collatrix.errors import EngineError, UsageError
from collatrix.generate import CSV_HEADER, MOST_DEMO_ROWS, generate
from collatrix.sources.sample import file_preview, inspect
from collatrix.sources.sink import ordered_values, write_single
from collatrix.spec import SortSpec

MOST_JOBS, MOST_HISTORY, MOST_FILES = 200, 100, 200
# Paths that are refused before anything else is asked of them.
SYSTEM_PATHS = ("/etc", "c:/windows")
MOST_JSON, MOST_UPLOAD = 64 << 20, 512 << 20
_OPTIONS = ("format", "key_type", "key_field", "delimiter", "nulls", "dedupe_keep", "output_format", "sql_table", "encoding_in", "encoding_out", "sheet", "split_by_size")
_FLAGS = ("header", "reverse", "ignore_case", "unique", "distinct", "verify", "backup", "resume")
_NUMBERS = ("limit", "split_by")
_LISTS = ("keys", "key_dir", "dedupe_by")


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Service:
    """Jobs and files under one folder."""

    def __init__(self, spark: SparkSession, root: str, token: str | None = None, concurrency: int | None = None):
        self.spark, self.root, self.token = spark, Path(root).resolve(), token
        self.jobs: dict[str, dict] = {}
        self.lock = threading.Lock()
        self.most_running = concurrency or os.cpu_count() or 1
        self.pool = ThreadPoolExecutor(self.most_running)
        self.history_file = self.root / ".history.jsonl"

    def path(self, name: str, exists: bool = True) -> Path:
        if any(str(name).lower().replace("\\", "/").startswith(p) for p in SYSTEM_PATHS):
            raise Refused(403, "system paths aren't served")
        found = (self.root / name).resolve()
        if found != self.root and self.root not in found.parents:
            raise Refused(403, "the path leaves the served folder")
        if exists and not found.exists():
            raise Refused(404, f"{name} isn't there")
        return found

    def spec_of(self, asked: dict) -> SortSpec:
        options = {k: asked[k] for k in (*_OPTIONS, *_FLAGS) if asked.get(k) is not None}
        options |= {k: int(asked[k]) for k in _NUMBERS if asked.get(k) is not None}
        options |= {k: tuple(asked[k]) for k in _LISTS if asked.get(k)}
        if asked.get("key_column") is not None:
            options["keys"] = (int(asked["key_column"]),)
        if not asked.get("input") or not asked.get("output"):
            raise Refused(400, "input and output are needed")
        try:
            # a result is downloaded, so it is no folder on any master
            return SortSpec(input=str(self.path(asked["input"])), output=str(self.path(asked["output"], exists=False)), force=True, output_layout="file", **options)
        except (UsageError, TypeError, ValueError) as e:
            raise Refused(400, str(e)) from e

    def submit(self, asked: dict) -> dict:
        spec = self.spec_of(asked)
        with self.lock:
            if sum(j["status"] in ("queued", "running") for j in self.jobs.values()) >= self.most_running:
                raise Refused(429, "all workers are busy")
            job = {"id": f"{time.time_ns():x}", "status": "queued", "asked": asked, "created": time.time()}
            self.jobs[job["id"]] = job
            for old in [k for k, j in self.jobs.items() if j["status"] not in ("queued", "running")][: max(0, len(self.jobs) - MOST_JOBS)]:
                del self.jobs[old]
        self.pool.submit(self._work, job, spec)
        return self.view(job)

    def _work(self, job: dict, spec: SortSpec) -> None:
        with self.lock:
            if job["status"] == "cancelled":
                return
            job["status"] = "running"
        tag = f"collatrix-{job['id']}"
        self.spark.addTag(tag)
        try:
            report = run(self.spark, spec)
            result = {"status": "done", "report": report}
        except EngineError as e:
            result = {"status": "error", "error": str(e), "exit_code": e.code}
        except Exception as e:  # noqa: BLE001  a job's failure is its result
            result = {"status": "error", "error": str(e)[:500], "exit_code": 1}
        finally:
            self.spark.removeTag(tag)
        with self.lock:
            if job["status"] != "cancelled":
                job |= result
            job["ended"] = time.time()
        self._remember(job)

    def _remember(self, job: dict) -> None:
        with self.lock:
            lines = self.history_file.read_text().splitlines() if self.history_file.exists() else []
            self.history_file.write_text("\n".join([*lines, json.dumps(self.view(job))][-MOST_HISTORY:]) + "\n")

    def view(self, job: dict) -> dict:
        return {k: v for k, v in job.items()}

    def job(self, key: str) -> dict:
        if key not in self.jobs:
            raise Refused(404, "no such job")
        return self.jobs[key]

    def cancel(self, key: str) -> dict:
        job = self.job(key)
        with self.lock:
            if job["status"] in ("queued", "running"):
                job["status"] = "cancelled"
        self.spark.interruptTag(f"collatrix-{key}")
        return self.view(job)

    def history(self) -> list[dict]:
        return [json.loads(x) for x in self.history_file.read_text().splitlines()] if self.history_file.exists() else []

    def metrics(self) -> dict:
        counts = {s: sum(j["status"] == s for j in self.jobs.values()) for s in ("queued", "running", "done", "error", "cancelled")}
        tracker = self.spark.sparkContext.statusTracker()
        done = [j["report"] for j in self.jobs.values() if j["status"] == "done"]
        totals = {"records": sum(r.get("records", 0) for r in done), "input_bytes": sum(r.get("input_bytes", 0) for r in done), "seconds": sum(r.get("timing", {}).get("total_s", 0) for r in done)}
        return {"version": __version__, "jobs": counts, "done": totals, "resident_bytes": resident_bytes(), "spark_active_stages": len(tracker.getActiveStageIds()), "spark_active_jobs": len(tracker.getActiveJobsIds())}

    def made(self, rows: int, kind: str, name: str) -> dict:
        rows = max(1, min(MOST_DEMO_ROWS, rows))
        target = self.path(name, exists=False)
        table = generate(self.spark, rows, kind)
        write_single(ordered_values(table, [table["_rid"]]), str(target), CSV_HEADER if kind == "csv" else None)
        return {"path": name, "rows": rows}


def _metrics_text(found: dict) -> str:
    lines = [f'collatrix_jobs{{status="{k}"}} {v}' for k, v in found["jobs"].items()]
    lines += [f"collatrix_done_{k} {v}" for k, v in found["done"].items()] + [f"collatrix_resident_bytes {found['resident_bytes']}"]
    return "\n".join([*lines, f"collatrix_spark_active_stages {found['spark_active_stages']}", f"collatrix_spark_active_jobs {found['spark_active_jobs']}", ""])


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: object) -> None:
            return

        def _send(self, body: object, status: int = 200, kind: str = "application/json") -> None:
            raw = body if isinstance(body, bytes) else body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _file(self, path: Path) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "application/octet-stream")
            self.send_header("Content-Length", str(path.stat().st_size))
            self.end_headers()
            with path.open("rb") as f:
                while block := f.read(1 << 20):
                    self.wfile.write(block)

        def _body(self, most: int) -> bytes:
            size = int(self.headers.get("Content-Length") or 0)
            if size > most:
                self.close_connection = True
                raise Refused(413, "the body is too large")
            return self.rfile.read(size)

        def _answer(self, act) -> None:
            parts = urlsplit(self.path)
            query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
            try:
                open_route = parts.path in ("/", "/api/health")
                given = (self.headers.get("Authorization") or "").removeprefix("Bearer ")
                if service.token and not open_route and not hmac.compare_digest(given, service.token):
                    raise Refused(401, "a token is needed")
                act(parts.path, query)
            except Refused as e:
                self._send({"error": str(e)}, e.status)
            except (KeyError, ValueError) as e:
                self._send({"error": f"bad request: {e}"}, 400)

        def do_GET(self) -> None:  # noqa: N802
            self._answer(self._get)

        def do_POST(self) -> None:  # noqa: N802
            self._answer(self._post)

        def _get(self, path: str, q: dict) -> None:
            if path == "/":
                self._send("<!doctype html><title>collatrix</title><p>See /api/health, /api/jobs and /metrics.", kind="text/html")
            elif path == "/api/health":
                self._send({"status": "ok", "version": __version__})
            elif path == "/metrics":
                self._send(service.metrics())
            elif path == "/metrics-prom":
                self._send(_metrics_text(service.metrics()), kind="text/plain")
            elif path == "/api/inspect":
                self._send(inspect(str(service.path(q["path"]))))
            elif path == "/api/preview":
                self._send(file_preview(str(service.path(q["path"])), int(q.get("n", 20))))
            elif path == "/api/files":
                folder = service.path(q.get("dir", "."))
                self._send([{"name": p.name, "bytes": p.stat().st_size, "dir": p.is_dir()} for p in sorted(folder.iterdir()) if not p.name.startswith(".")][:MOST_FILES])
            elif path == "/api/history":
                self._send(service.history())
            elif path in ("/api/status", "/api/jobs"):
                self._send([service.view(j) for j in service.jobs.values()])
            elif path == "/api/job":
                self._send(service.view(service.job(q["id"])))
            elif found := re.fullmatch(r"/api/job/([0-9a-f]+)(/result)?", path):
                job = service.job(found[1])
                if found[2]:
                    if job["status"] != "done":
                        raise Refused(409, "the job has no result")
                    self._file(Path(job["report"]["files"][0]))
                else:
                    self._send(service.view(job))
            elif path == "/api/gen":
                self._send(service.made(int(q.get("rows", 1000)), q.get("mode", "csv"), q.get("name", "demo.csv")))
            elif path == "/download":
                self._file(service.path(q["path"]))
            else:
                raise Refused(404, "no such route")

        def _post(self, path: str, q: dict) -> None:
            if path == "/api/upload":
                name = re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(q["filename"])).lstrip(".") or "upload"
                raw = self._body(MOST_UPLOAD)
                target = service.path(f"uploads/{name}", exists=False)
                target.parent.mkdir(exist_ok=True)
                target.write_bytes(raw)
                return self._send({"path": f"uploads/{name}", "bytes": len(raw)})
            asked = json.loads(self._body(MOST_JSON) or b"{}")
            if path == "/api/sort":
                self._send(service.submit(asked), 202)
            elif path == "/api/cancel":
                self._send(service.cancel(asked["id"]))
            elif path == "/api/rerun":
                found = next((h for h in service.history() if h["id"] == asked["id"]), None)
                if found is None:
                    raise Refused(404, "not in the history")
                self._send(service.submit(found["asked"]), 202)
            elif path == "/api/history/clear":
                service.history_file.unlink(missing_ok=True)
                self._send({"status": "ok"})
            else:
                raise Refused(404, "no such route")

    return Handler


def serve(spark: SparkSession, root: str, port: int = 0, host: str = "127.0.0.1", token: str | None = None) -> ThreadingHTTPServer:
    """A running server; ``shutdown()`` ends it."""
    server = ThreadingHTTPServer((host, port), handler(Service(spark, root, token)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
