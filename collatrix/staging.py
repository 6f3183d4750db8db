"""Tables kept between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []
_SCOPES: ContextVar[tuple] = ContextVar("collatrix_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves a local master (tests); a cluster without the
    setting is an error, since a machine-local folder would lose files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="collatrix-")
    return _OWN_DIR[app]


def _remove(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch space
            return


def _remove_staged() -> None:
    _remove(_STAGED)


class Staged:
    """Tables staged in a block of work, in the order of staging."""

    def __init__(self) -> None:
        self.entries: list[tuple[SparkSession, str]] = []

    def drop(self, keep: Sequence[DataFrame] = ()) -> None:
        """Remove all that were staged so far but ``keep``; no table still in use may read them. Shuffle files
        of finished steps go too, as their plans are no longer held."""
        held = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
        gone = [e for e in self.entries if not any(h.endswith(e[1].split(":", 1)[-1].lstrip("/")) for h in held)]
        self.entries = [e for e in self.entries if e not in gone]
        for e in gone:
            if e in _STAGED:
                _STAGED.remove(e)
        _remove(gone)
        if gone:
            gc.collect()
            gone[0][0]._jvm.System.gc()


@contextlib.contextmanager
def scope(remove: bool = True) -> Iterator[Staged]:
    """Tables staged in the block are removed at its end, unless an outer block still needs them."""
    found = Staged()
    outer = _SCOPES.get()
    token = _SCOPES.set((*outer, found))
    try:
        yield found
    finally:
        _SCOPES.reset(token)
        if remove:
            found.drop()


atexit.register(_remove_staged)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation. The files are removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/collatrix/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    for block in _SCOPES.get():
        block.entries.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
