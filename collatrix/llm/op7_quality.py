"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled training rows, added up in Spark. The
covariances shrink towards the pooled one and its diagonal; their Cholesky factors are computed
once and travel with the model, and a score is the logistic of the difference of the classes'
Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm import tokens as tk
from collatrix.llm.common import as_row, from_row, held_out, map_arrow, ship, stage, table, with_fields

THRESHOLD = 0.3
#: Words at which a text's statistics count half.
DAMPING = 5.0
#: Weights of the class's own covariance, the pooled one, and the pooled diagonal.
SHRINKAGE = (0.8, 0.1, 0.1)

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:?'\"-()",
    "mark": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "bang": b"!",
    "bar": b"|",
    "line": b"\n",
    "high": range(128, 256),
}
_TABLES = {}
for _name, _bytes in _CLASSES.items():
    _TABLES[_name] = np.zeros(256, np.int32)
    _TABLES[_name][list(_bytes)] = 1

FEATURES = (
    "words", "word length", "word length spread", "upper case", "digits", "stops", "marks", "exclamations", "bars", "lines",
    "beyond ASCII", "repeated neighbours", "distinct words", "distinct pairs", "words with a mark at the end", "short words", "capitalised words",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row a text; shares enter as smoothed log odds, counts as logs."""
    words = tk.Words(data, offsets, tk.SPACE, lower=False)
    n_texts = len(offsets) - 1
    count = {}
    for name, table_ in _TABLES.items():
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table_[data], out=total[1:])
        count[name] = np.diff(total[offsets]).astype(float)
    chars = np.diff(offsets).astype(float)
    n = np.diff(words.first).astype(float)
    of = tk.owner(words.first, len(words))
    per_text = lambda values: np.bincount(of, values, n_texts)
    lengths = (words.end - words.start).astype(float)
    mean = per_text(lengths) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(0, per_text(lengths**2) / np.maximum(n, 1) - mean**2))
    same = np.zeros(len(words))
    distinct = np.zeros(n_texts)
    pairs = np.zeros(n_texts)
    if len(words):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
        salt = tk.mix(of.astype(tk.U) + tk.U(1))
        for hashes, own, out in ((words.hash ^ salt, of, distinct), (tk.grams(words.hash, 2) ^ salt[:-1], of[:-1], pairs)):
            if out is pairs:
                inside = of[1:] == of[:-1]
                hashes, own = hashes[inside], own[inside]
            order = np.argsort(hashes)
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = hashes[order][1:] != hashes[order][:-1]
            out += np.bincount(own[order], fresh, n_texts)
    mark_end = per_text(_TABLES["mark"][data[words.end - 1]].astype(float)) if len(words) else np.zeros(n_texts)
    capital = per_text(_TABLES["upper"][data[words.start]].astype(float)) if len(words) else np.zeros(n_texts)
    odds = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5) * (1 + 2 / (whole + 1)))
    letters = count["upper"] + count["lower"]
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), odds(count["upper"], letters), odds(count["digit"], chars), odds(count["stop"], chars),
        odds(count["mark"], chars), odds(count["bang"], chars), odds(count["bar"], chars), np.log((count["line"] + 1) / (n + 1)),
        odds(count["high"], chars), odds(per_text(same), n), odds(distinct, n), odds(pairs, np.maximum(n - 1, 0)), odds(mark_end, n),
        odds(per_text((lengths <= 2).astype(float)), n), odds(capital, n),
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.utf8(tk.text_of(batch))
        keys = [c for c in batch.schema.names if c != "text"]
        for lo, hi in tk.chunks(offsets):
            found = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows = batch.slice(lo, hi - lo)
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keys], lists], names=[*keys, "stats"])


def damp(stats: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Statistics of few words say little: they move towards the mean by the number of words."""
    n = np.expm1(stats[:, :1])
    out = centre + (stats - centre) * (n / (n + DAMPING))
    out[:, 0] = stats[:, 0]
    return out


def _sums(centre: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class: rows, sum and sum of outer products of the statistics, damped if a centre is known."""
        d = len(FEATURES)
        n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column("stats").flatten()).reshape(-1, d)
            x = x if centre is None else damp(x, centre)
            y = np.array(batch.column("label"))
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                first[c] += own.sum(0)
                second[c] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(first)), pa.array(list(second.reshape(2, -1)))], names=["label", "n", "first", "second"])

    return run


@dataclass
class Discriminant:
    """Centre for damping, scaling and, of each class, mean, inverse Cholesky factor and constant."""

    towards: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    roots: list[np.ndarray]
    constants: list[float]

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = (damp(stats, self.towards) - self.centre) / self.scale
        log = [c - 0.5 * (((z - m) @ root.T) ** 2).sum(1) for m, root, c in zip(self.means, self.roots, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(n: np.ndarray, first: np.ndarray, second: np.ndarray, towards: np.ndarray, shrinkage: tuple[float, float, float] = SHRINKAGE) -> Discriminant:
    """From the sums of both classes. A class without rows takes the pooled mean and covariance, so
    that priors alone (smoothed by one row each) decide."""
    d = first.shape[1]
    total = max(n.sum(), 1)
    centre = first.sum(0) / total
    spread = second.sum(0) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    means, own = [], []
    for c in (0, 1):
        m = first[c] / n[c] if n[c] else centre
        cov = second[c] / n[c] - np.outer(m, m) if n[c] else spread
        means.append((m - centre) / scale)
        own.append(cov / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / total if n.sum() else np.eye(d)
    a, b, g = shrinkage
    roots, constants = [], []
    for c in (0, 1):
        root = np.linalg.cholesky(a * own[c] + b * pooled + g * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d))
        roots.append(np.linalg.inv(root))
        constants.append(float(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(root)).sum()))
    return Discriminant(towards, centre, scale, means, roots, constants)


def measure(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return map_arrow(docs.select(*keep, *([] if "_row" in keep else ["text"])), _measure, with_fields(docs, keep, "stats array<double>"))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of ``stats`` (doc_id, stats) whose id isn't held out and has a 0/1 label.

    Repeated labels or documents of an id count once for each pair; null ids and labels not at all.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    joined = stage(stats.join(known, "doc_id").select("stats", "label"), "quality-training")
    d = len(FEATURES)
    total = lambda name: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(d * d if name == "second" else d)]).alias(name)

    def sums(centre: np.ndarray | None):
        n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d * d))
        found = map_arrow(joined, _sums(centre), "label int, n double, first array<double>, second array<double>")
        for row in found.groupBy("label").agg(F.sum("n").alias("n"), total("first"), total("second")).collect():  # two rows
            n[row.label], first[row.label], second[row.label] = row.n, row.first, row.second
        return n, first, second.reshape(2, d, d)

    n, first, _ = sums(None)
    towards = first.sum(0) / max(n.sum(), 1)
    return fit(*sums(towards), towards)


def score(stats: DataFrame, model: Discriminant, keep: tuple[str, ...]) -> DataFrame:
    ship(stats.sparkSession)
    sent = stats.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sent.value.score(np.array(batch.column("stats").flatten()).reshape(-1, d)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got)], names=[*keep, "score"])

    return map_arrow(stats.select(*keep, "stats"), run, with_fields(stats, keep, "score double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each row of ``docs``.

    Learns from rows of ``labels`` (doc_id, quality) that are not held out; scores use the text
    alone, whole. Null text counts as empty and is scored like it. Repeated rows get equal scores.
    Without labels every score comes from the prior, one half. Empty tables give no rows; other
    columns are ignored.
    """
    stats = stage(measure(docs, ("doc_id",)), "quality-stats")
    return score(stats, train(stats, labels), ("doc_id",))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``. Rows are staged once with their
    statistics, which serve training and scoring."""
    stats = stage(measure(as_row(docs), ("_row",)), "quality-stats")
    model = train(stats.select(F.col("_row.doc_id").alias("doc_id"), "stats"), labels)
    scored = score(stats, model, ("_row",))
    return from_row(scored.filter(F.col("score") >= threshold), docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
