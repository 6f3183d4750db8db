"""New files of a folder, each sorted on its own, with Structured Streaming."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from collatrix.engine import run
from collatrix.errors import EngineError, UsageError
from collatrix.spec import SortSpec

PREFIX = "sorted-"


def watch(spark: SparkSession, folder: str, output_dir: str, spec: SortSpec, checkpoint: str, existing: bool = False, once: bool = True, log_file: str | None = None) -> StreamingQuery:
    """Sort each file that appears in ``folder`` to ``output_dir/sorted-NAME`` by the whole of ``spec``, one
    file on any master unless it asks for a folder.

    The stream's checkpoint remembers the files, so a restart takes up only new ones. Files that
    are there at the first start are passed over unless ``existing``. ``once`` stops when all
    present files are done; else the stream goes on. A file that fails is logged and doesn't stop
    the others. Writers should rename finished files into the folder.
    """
    if os.path.realpath(folder) == os.path.realpath(output_dir):
        raise UsageError("the output folder can't be the watched one")
    os.makedirs(output_dir, exist_ok=True)
    known = Path(checkpoint) / "passed-over"
    if not known.exists():
        known.parent.mkdir(parents=True, exist_ok=True)
        known.write_text("" if existing else "\n".join(sorted(os.listdir(folder))))
    passed_over = set(known.read_text().split("\n"))
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select(F.url_decode(F.regexp_replace("path", r"^file:(//)?", "")).alias("path")).distinct().orderBy("path").collect():
            name = os.path.basename(row.path)
            if name in passed_over or name.startswith((".", PREFIX)):
                continue
            one = spec.with_(input=row.path, output=os.path.join(output_dir, PREFIX + name), force=True, verify=True, log_file=log_file, output_layout=spec.output_layout or "file")
            try:
                run(batch.sparkSession, one)
            except EngineError:
                continue  # it is in the log

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(checkpoint, "stream"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
