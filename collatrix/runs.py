"""Staged runs that can be taken up again: manifest, lock and guards."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from collatrix.errors import PreflightError
from collatrix.spec import SortSpec

TEMP_ENV = "COLLATRIX_TEMP_DIR"
#: Options that don't change what a run computes.
_FREE = ("resume", "force", "backup", "log_file", "verify", "max_memory", "threads", "output_layout", "split_bytes")


def base_dir(spark: SparkSession | None = None) -> Path:
    """Where staged runs are kept: the environment's choice, the cluster's shared folder or, for a local
    master, the home folder."""
    if os.environ.get(TEMP_ENV):
        return Path(os.environ[TEMP_ENV])
    spark = spark or SparkSession.active()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return Path(re.sub(r"^file:(//)?", "", found)) / "collatrix-runs"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise PreflightError(f"set spark.checkpoint.dir or {TEMP_ENV} to a folder that all executors share")
    return Path.home() / ".collatrix"


def spec_hash(spec: SortSpec) -> str:
    held = {k: v for k, v in asdict(spec).items() if k not in _FREE}
    return hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(path: str) -> dict:
    s = os.stat(path)
    return {"path": os.path.realpath(path), "bytes": s.st_size, "mtime_ns": s.st_mtime_ns}


class Run:
    """A folder with the manifest and, once it is complete, the keyed and reduced records as Parquet."""

    def __init__(self, folder: Path):
        self.folder = folder
        self.data = folder / "records"
        self._lock = folder / ".lock"

    @property
    def manifest(self) -> dict:
        return json.loads((self.folder / "manifest.json").read_text())

    @property
    def staged(self) -> bool:
        return (self.data / "_SUCCESS").exists()

    def save(self, **values) -> None:
        part = self.folder / ".manifest.part"
        old = self.manifest if (self.folder / "manifest.json").exists() else {}
        part.write_text(json.dumps(old | values))
        os.replace(part, self.folder / "manifest.json")

    def lock(self) -> None:
        try:
            with open(self._lock, "x") as f:
                f.write(str(os.getpid()))
        except FileExistsError:
            raise PreflightError(f"run {self.folder.name} is in use") from None

    def unlock(self) -> None:
        self._lock.unlink(missing_ok=True)

    def remove(self) -> None:
        """Delete the run, and nothing outside the base folder."""
        if base_dir().resolve() not in self.folder.resolve().parents:
            raise PreflightError(f"{self.folder} isn't a run's folder")
        shutil.rmtree(self.folder, ignore_errors=True)


def start(spec: SortSpec, path: str) -> Run:
    folder = base_dir() / f"run-{time.time_ns()}"
    folder.mkdir(parents=True)
    run = Run(folder)
    run.save(spec=spec_hash(spec), input=fingerprint(path), output=spec.output, finished=False, started=time.time())
    return run


def resumable() -> list[Run]:
    """Unfinished runs, the newest first."""
    found = [Run(p.parent) for p in base_dir().glob("run-*/manifest.json")]
    return sorted((r for r in found if not r.manifest["finished"]), key=lambda r: r.folder.name, reverse=True)


def listing() -> list[dict]:
    """What there is to take up: id, input, output, whether its records are staged, and its age in seconds."""
    now = time.time()
    return [{"id": r.folder.name, "input": m["input"]["path"], "output": m["output"], "staged": r.staged, "age_s": round(now - m["started"])} for r in resumable() for m in [r.manifest]]


def take_up(spec: SortSpec, path: str) -> Run | None:
    """The newest unfinished run of the same options on the same unchanged input."""
    mine, now = spec_hash(spec), fingerprint(path)
    return next((r for r in resumable() if r.manifest["spec"] == mine and r.manifest["input"] == now), None)
