"""Memory and thread limits of a run as settings of its session, and the memory it took."""

from __future__ import annotations

import contextlib
import os
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from collatrix.functions.values import parse_size
from collatrix.spec import SortSpec

MEMORY_ENV = "COLLATRIX_MAX_MEMORY"
#: Room that a task needs for each byte of its input: the record, its keys and what the sort holds.
ROOM = 8


def memory_limit(spec: SortSpec) -> int | None:
    """The option's bytes, else the environment's."""
    if spec.max_memory is not None:
        return spec.max_memory
    return parse_size(os.environ[MEMORY_ENV]) if os.environ.get(MEMORY_ENV) else None


def settings(spec: SortSpec, input_bytes: int, cores: int) -> dict[str, str]:
    """Settings under which a task's share of the memory holds its partition: smaller scans and more
    shuffle partitions. Spark spills what is beyond; the session's own memory is fixed at its start."""
    limit, out = memory_limit(spec), {}
    tasks = min(spec.threads or cores, cores)
    if limit is not None:
        share = max(1 << 20, limit // tasks // ROOM)
        out["spark.sql.files.maxPartitionBytes"] = str(min(128 << 20, share))
        out["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(min(64 << 20, share))
        out["spark.sql.shuffle.partitions"] = str(max(tasks, -(-input_bytes // share)))
    elif spec.threads is not None:
        out["spark.sql.shuffle.partitions"] = str(spec.threads)
    return out


@contextlib.contextmanager
def budget(spark: SparkSession, spec: SortSpec) -> Iterator[None]:
    """The settings for one run, put back after it."""
    size = sum(os.path.getsize(p) for p in (spec.input, *spec.merge) if p and os.path.isfile(p))
    asked = settings(spec, size, spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _family() -> list[int]:
    """This process and all below it."""
    parents: dict[int, list[int]] = {}
    for p in Path("/proc").glob("[0-9]*/stat"):
        with contextlib.suppress(OSError, ValueError, IndexError):
            parents.setdefault(int(p.read_text().rsplit(")", 1)[1].split()[1]), []).append(int(p.parent.name))
    found = [os.getpid()]
    for pid in found:
        found += parents.get(pid, [])
    return found


def resident_bytes() -> int:
    """Resident memory of the driver, its JVM and, with a local master, the Python workers."""
    total = 0
    for pid in _family():
        with contextlib.suppress(OSError, ValueError, IndexError):
            total += int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    return total


class PeakMemory:
    """The most that ``resident_bytes`` came to, sampled while the block runs."""

    def __init__(self, every: float = 0.05):
        self.every, self.bytes, self._over = every, 0, threading.Event()
        self._thread = threading.Thread(target=self._sample, daemon=True)

    def _sample(self) -> None:
        while not self._over.is_set():
            self.bytes = max(self.bytes, resident_bytes())
            self._over.wait(self.every)

    def __enter__(self) -> PeakMemory:
        self.bytes = resident_bytes()
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._over.set()
        self._thread.join()
