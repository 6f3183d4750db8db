"""From ``documents`` to a training mix: quality, line dedup, near duplicates, benchmark leaks, mixing.

Each stage takes all that the one before kept. The tables between stages are Parquet in the shared
folder. ``ORACLE_SQL`` is None, as SQL can't express the trained classifier; tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.common import scope, stage, table
from collatrix.llm.op3_lines import cut_lines
from collatrix.llm.op4_jaccard import one_of_each
from collatrix.llm.op6_mix import mix_sources
from collatrix.llm.op7_quality import keep_good
from collatrix.llm.op9_decontaminate import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labels of ``docs`` that aren't held out.

    Null texts are scored as empty ones; repeated rows share their fate; an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose all their words so. ``n_chars`` counts the new text.

    Null and empty texts stay as they are. Every row is a document of its own, also where ids are null
    or repeated, so of equal rows the first keeps its lines and the others go."""
    found = cut_lines(docs)
    left = F.when(F.col("_removed") > 0, F.col("_cut").rlike(r"[^\x20\x09-\x0D]")).otherwise(F.lit(True))
    size = F.when(F.col("_removed") > 0, F.char_length("_cut").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("_cut"), "n_chars": size}
    return found.filter(left).select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the least id (null ids last), then of the least hash of its text.

    Rows without words link with nothing and stay."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Rows without words, null texts among them, stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many of their words the mix takes: all columns, then size, source_size, target
    and taken (whole rounds of a text's words, then its first words).

    Rows without words have size and taken 0; null sources are a source; repeated rows count each."""
    return mix_sources(docs, carry=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage staged on its way is removed when its result is written,
    and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    with scope(remove=False) as staged:
        for name, function in STAGES:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
            staged.drop(keep=[docs])
    return docs
