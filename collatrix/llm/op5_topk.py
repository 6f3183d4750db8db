"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks and stay where they are; queries come to them, a bounded batch at a
time. Every round scores all pairs of the batch and counts every score that is not below its query's
interval in a histogram; the histograms are summed over all tasks and narrow the interval that holds
the query's k-th highest score, until that score is known. A last round keeps the scores above it
and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.llm.common import map_arrow, ship, stage, table

K = 5
QUERY_EVERY = 50
SCALE = 256
#: A histogram has 2**BITS bins.
BITS = 10
#: Vectors packed into one block, and bytes of scaled components that a block holds at most.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
#: Queries that one pass over the vectors answers: their vectors are broadcast (BATCH_BYTES at most) and
#: their histograms held by a task, 4 bytes a bin.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20
#: Scores that a task holds at a time.
CELL = 1 << 21
#: Scaled components of this size and more are held as they are and multiplied as whole numbers.
HUGE = float(1 << 26)
_TOP = np.uint64(1 << 63)
_BLOCK = "ids binary, dim int, data binary, huge array<struct<id:long,v:array<double>>>, top double"


def _scaled(x: float) -> int:
    """floor(256 * x), exactly."""
    n, d = x.as_integer_ratio()
    return SCALE * n // d


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding) to blocks: ids and scaled components of ordinary vectors, padded with
    zeros to the block's longest; vectors with a huge component aside; and the greatest length."""

    def block(rows: list[tuple[int, np.ndarray]], huge: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        dim = max((len(v) for _, v in rows), default=0)
        out = np.zeros((len(rows), dim), np.int32)
        for line, (_, v) in zip(out, rows, strict=True):
            line[: len(v)] = v
        top = float(np.sqrt((out.astype(float) ** 2).sum(1)).max(initial=0))
        cells = [[np.array([i for i, _ in rows], np.int64).tobytes()], [dim], [out.tobytes()], [[{"id": i, "v": v.tolist()} for i, v in huge]], [top]]
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float64()))])), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["ids", "dim", "data", "huge", "top"])

    rows: list[tuple[int, np.ndarray]] = []
    huge: list[tuple[int, np.ndarray]] = []
    longest = 1
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if (np.abs(v) * SCALE < HUGE).all():
                rows.append((i, np.floor(v * SCALE)))
            else:
                huge.append((i, v))
            longest = max(longest, len(v))
            held = len(rows) + len(huge)
            if held >= BLOCK_ROWS or held * longest * 4 >= BLOCK_BYTES:
                yield block(rows, huge)
                rows, huge, longest = [], [], 1
    if rows or huge:
        yield block(rows, huge)


@dataclass
class Vectors:
    """A block's ordinary vectors as a matrix, and its huge ones as lists of whole numbers."""

    ids: np.ndarray
    matrix: np.ndarray
    huge_ids: np.ndarray
    huge: list[list[int]]

    @staticmethod
    def of(ids: bytes, dim: int, data: bytes, huge: list[dict]) -> Vectors:
        found = np.frombuffer(ids, np.int64)
        return Vectors(found, np.frombuffer(data, np.int32).reshape(len(found), dim), np.array([h["id"] for h in huge], np.int64), [[_scaled(x) for x in h["v"]] for h in huge])

    def rows(self, a: int, b: int) -> Vectors:
        return Vectors(self.ids[a:b], self.matrix[a:b], self.huge_ids[:0], [])

    def whole(self) -> list[list[int]]:
        return [[int(x) for x in line] for line in self.matrix]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Integer inner products: in doubles where those are exact, else in 64-bit integers, else none."""
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    bound = int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(v.astype(np.int64)).max(initial=0)) * dim
    if bound < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ v.T.astype(np.int64) if bound < 1 << 63 else None


def _slow(q: list[list[int]], v: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of whole numbers of any size, and which of them are longs."""
    exact = [[sum(a * b for a, b in zip(x, y, strict=False)) for y in v] for x in q]
    fits = np.array([[-(1 << 63) <= s < 1 << 63 for s in line] for line in exact], bool).reshape(len(q), len(v))
    return np.array([[s if ok else 0 for s, ok in zip(line, good, strict=True)] for line, good in zip(exact, fits.tolist(), strict=True)], np.int64).reshape(len(q), len(v)), fits


@dataclass
class Batch:
    """Queries of one pass, and the low end of each one's interval as an unsigned number: scores with
    their top bit turned, so that unsigned order is that of the scores."""

    ids: np.ndarray
    ordinary: Vectors
    low: np.ndarray

    def cells(self, block: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first query, vector ids, scores with turned top bit, which count) of the batch with a block, a
        cell of bounded size at a time. A query's own row and scores that are no longs don't count."""
        n = len(self.ordinary.ids)
        step = max(1, CELL // max(1, len(block.ids)))
        for at in range(0, n, step):
            q = self.ordinary.rows(at, at + step)
            if len(block.ids):
                yield self._cell(at, q, block.ids, block.matrix, None)
            if block.huge:
                yield self._cell(at, q, block.huge_ids, None, block.huge)
        if self.ordinary.huge:
            q = Vectors(self.ordinary.huge_ids, np.zeros((0, 0), np.int32), self.ordinary.huge_ids[:0], self.ordinary.huge)
            for ids, values in ((block.ids, block.whole() if len(block.ids) else []), (block.huge_ids, block.huge)):
                if len(ids):
                    scores, fits = _slow(q.huge, values)
                    yield n, ids, scores.view(np.uint64) ^ _TOP, fits & (q.ids[:, None] != ids[None])

    @staticmethod
    def _cell(at: int, q: Vectors, ids: np.ndarray, matrix: np.ndarray | None, huge: list | None):
        scores, fits = (_products(q.matrix, matrix), None) if matrix is not None else (None, None)
        if scores is None:
            scores, fits = _slow(q.whole(), huge if huge is not None else [[int(x) for x in line] for line in matrix])
        counts = q.ids[:, None] != ids[None]
        return at, ids, scores.view(np.uint64) ^ _TOP, counts if fits is None else counts & fits


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    for batch in batches:
        for i in range(len(batch)):
            yield Vectors.of(*[batch.column(c)[i].as_py() for c in ("ids", "dim", "data", "huge")])


def _histograms(batch, k: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, bin, n): every score of the task's vectors that isn't below its query's interval is counted.
        Scores over the interval fall into one more bin. The k-th score of all can't be below the bins
        that hold the task's own k highest, so lower bins aren't sent."""
        asked: Batch = batch.value
        bins = (1 << BITS) + 1
        counts = np.zeros((len(asked.ids), bins), np.int32)
        for block in _blocks_in(batches):
            for at, _, scores, good in asked.cells(block):
                low = asked.low[at : at + len(scores), None]
                row, col = np.nonzero(good & (scores >= low))
                place = np.minimum((scores[row, col] - low[row, 0]) >> np.uint64(shift), np.uint64(bins - 1)).astype(np.int64)
                counts[at : at + len(scores)] += np.bincount(row * bins + place, minlength=len(scores) * bins).reshape(len(scores), bins).astype(np.int32)
        for at in range(0, len(counts), 512):
            some = counts[at : at + 512]
            above = some[:, ::-1].cumsum(1, dtype=np.int64)[:, ::-1] - some
            row, col = np.nonzero((some > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(row + at), pa.array(col), pa.array(some[row, col].astype(np.int64))], names=["row", "bin", "n"])

    return run


def _winners(batch, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, vec_id, score): scores over a query's k-th and, of those equal to it, the k smallest ids of
        each cell."""
        asked: Batch = batch.value
        for block in _blocks_in(batches):
            for at, ids, scores, good in asked.cells(block):
                low = asked.low[at : at + len(scores), None]
                order = np.argsort(ids, kind="stable")
                ids, scores, good = ids[order], scores[:, order], good[:, order]
                ties = good & (scores == low)
                row, col = np.nonzero((good & (scores > low)) | (ties & (np.cumsum(ties, 1) <= k)))
                yield pa.RecordBatch.from_arrays([pa.array(row + at), pa.array(ids[col]), pa.array((scores[row, col] ^ _TOP).view(np.int64))], names=["row", "vec_id", "score"])

    return run


def _batches(asked: DataFrame) -> Iterator[tuple[np.ndarray, Vectors, float]]:
    """Blocks of queries, one after another on the driver, put together to batches of bounded size."""
    held, size = [], 0

    def joined() -> tuple[np.ndarray, Vectors, float]:
        dim = max(v.matrix.shape[1] for v, _ in held)
        wide = [np.pad(v.matrix, ((0, 0), (0, dim - v.matrix.shape[1]))) for v, _ in held]
        ids, huge_ids = np.concatenate([v.ids for v, _ in held]), np.concatenate([v.huge_ids for v, _ in held])
        return np.concatenate([ids, huge_ids]), Vectors(ids, np.concatenate(wide), huge_ids, [h for v, _ in held for h in v.huge]), max(t for _, t in held)

    for r in asked.toLocalIterator():
        whole = Vectors.of(bytes(r["ids"]), r["dim"], bytes(r["data"]), [h.asDict() for h in r["huge"]])
        for a in range(0, max(1, len(whole.ids)), BATCH_ROWS):
            v = whole.rows(a, a + BATCH_ROWS)
            v = Vectors(v.ids, v.matrix, whole.huge_ids, whole.huge) if a == 0 else v
            rows, weight = len(v.ids) + len(v.huge), v.matrix.nbytes
            if held and (size + rows > BATCH_ROWS or sum(x.matrix.nbytes for x, _ in held) + weight > BATCH_BYTES):
                yield joined()
                held, size = [], 0
            held.append((v, r["top"]))
            size += rows
    if held:
        yield joined()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` highest integer inner products of each query over all other rows.

    Both tables have vec_id long and embedding array<float or double>. Components become
    floor(256 * x). Rows with a null id, a null vector, or null or non-finite components take no
    part; of vectors of unlike lengths the shorter counts as zero-filled. A query is not its own
    candidate (rows with its id are left out); ties go to the smaller vec_id. Repeated rows are
    candidates each; a repeated query row is answered each time. Scores are exact however large the
    components; a pair whose score is no 64-bit number takes no part. Out: query_id, rank (from 1),
    vec_id, score; fewer than ``k`` rows where there are fewer candidates. Empty tables give no
    rows; other columns are ignored.

    Vectors are packed once and never shuffled: of each batch of queries, tasks send at most about
    ``k`` bins or rows a query. Passes over the vectors grow with the queries, as do the scores.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    pick = lambda df: df.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = stage(map_arrow(pick(queries), _pack, _BLOCK), "topk-queries")
    blocks = stage(map_arrow(pick(vectors), _pack, _BLOCK), "topk-vectors")
    answer = "query_id long, rank int, vec_id long, score long"
    whole = blocks.agg(F.max("top").alias("top"), F.max(F.size("huge")).alias("huge")).first()
    found: list[DataFrame] = []
    for ids, ordinary, top in _batches(asked) if whole.top is not None else ():
        # by Cauchy and Schwarz, unless huge components are about
        bound = (1 << 63) - 1 if whole.huge or ordinary.huge else min((1 << 63) - 1, int(top * whole.top * (1 + 1e-9)) + 1)
        low = np.full(len(ids), (1 << 63) - bound, np.uint64)
        shift = max(0, (2 * bound).bit_length() - BITS)
        while True:
            sent = spark.sparkContext.broadcast(Batch(ids, ordinary, low))
            bins = map_arrow(blocks, _histograms(sent, k, shift), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")))
            kth = bins.withColumn("upto", upto).filter(F.col("upto") >= k).groupBy("row").agg(F.max("bin").alias("bin"))
            for r in kth.collect():  # one row a query of the batch
                if r.bin < 1 << BITS:  # else k scores are over the interval, which can't be after a round
                    low[r.row] += np.uint64(r.bin << shift)
            sent.destroy()
            if not shift:
                break
            shift = max(0, shift - BITS)
        sent = spark.sparkContext.broadcast(Batch(ids, ordinary, low))
        best = map_arrow(blocks, _winners(sent, k), "row long, vec_id long, score long")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        named = F.get(F.lit(ids.tolist()), F.col("row").cast("int"))
        found.append(stage(best.select(named.alias("query_id"), "rank", "vec_id", "score"), "topk-answers"))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], answer)
    paths = [f.rsplit("/", 1)[0] for df in found for f in df.inputFiles()[:1]]
    return spark.read.schema(answer).parquet(*paths) if paths else spark.createDataFrame([], answer)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), vectors)
