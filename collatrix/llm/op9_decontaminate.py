"""Benchmark decontamination by winnowing.

Texts are reduced to fingerprints: the least hash of every window of consecutive k-grams. With
k-grams of 6 words in windows of 5, any shared run of 10 words holds a k-gram that is chosen on both
sides, so the join of fingerprints misses none. Joined fingerprints are extended over the 10-word
runs around them, which are looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm import tokens as tk
from collatrix.llm.common import as_row, from_row, map_arrow, ship, stage, table, with_fields

SPAN = 10
GRAM = 6
WINDOW = SPAN - GRAM + 1
#: Benchmark bytes that one broadcast index may cover; a larger benchmark is taken in several parts.
PART_BYTES = 32 << 20
_NUMBER = "_leaks_number"


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram (the rightmost of equals) of each full window, all in one text or
    not: callers ignore windows that cross texts."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    left = np.ones(n, bool)
    for j in range(window - 1, -1, -1):
        hit = left & (grams[j : j + n] == least)
        chosen[np.flatnonzero(hit) + j] = True
        left &= ~hit
    return np.flatnonzero(chosen)


class BenchmarkIndex:
    """Fingerprints and exact windows of some benchmark items, as sorted arrays."""

    def __init__(self, items: list[str], texts: list[str]):
        self.items = items
        words = tk.Words(*tk.utf8(pa.array(texts, pa.large_string())), tk.NOT_ALNUM)
        long_windows, long_items, prints = [], [], []
        short: dict[int, tuple[list, list]] = {}
        for i in range(len(items)):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if not len(own):
                continue
            if len(own) < SPAN:
                hashes, of = short.setdefault(len(own), ([], []))
                hashes.append(tk.grams(own, len(own))[0])
                of.append(i)
                continue
            windows = np.unique(tk.grams(own, SPAN))
            long_windows.append(windows)
            long_items.append(np.full(len(windows), i))
            grams = tk.grams(own, GRAM)
            prints.append(grams[winnow(grams, WINDOW)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, tk.U)
        self.by_length = {n: self._sorted(np.array(h, tk.U), np.array(of)) for n, (h, of) in sorted(short.items())}
        if long_windows:
            self.by_length[SPAN] = self._sorted(np.concatenate(long_windows), np.concatenate(long_items))

    @staticmethod
    def _sorted(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, offsets, and the items of each hash."""
        order = np.lexsort((items, hashes))
        distinct, first = np.unique(hashes[order], return_index=True)
        return distinct, np.append(first, len(order)), items[order]


def _isin(values: np.ndarray, table_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table_, values)
    at[at == len(table_)] = 0
    return table_[at] == values if len(table_) else np.zeros(len(values), bool)


def hits(words: tk.Words, index: BenchmarkIndex) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The text of each word and, for each length of runs, (first word, length, place of the run in
    the index) of all runs that items have too."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    of = tk.owner(words.first, len(words))
    last = words.first[1:][of] if len(words) else np.zeros(0, np.int64)
    for length, (distinct, offsets, items) in index.by_length.items():
        if length == SPAN:
            grams = tk.grams(words.hash, GRAM)
            chosen = winnow(grams, WINDOW)
            chosen = chosen[_isin(grams[chosen], index.prints)]
            starts = np.unique((chosen[:, None] - np.arange(WINDOW)).ravel())  # the runs that hold the k-gram
            starts = starts[starts >= 0]
        else:
            starts = np.arange(len(words))
        starts = starts[starts + length <= last[starts]]
        if not len(starts):
            continue
        if length == SPAN:
            total = np.full(len(starts), (length * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF, tk.U)
            for j in range(length):
                total = total * tk.U(tk._BASE) + words.hash[starts + j]
            runs = tk.mix(total)
        else:
            runs = tk.grams(words.hash, length)[starts]
        found = _isin(runs, distinct)
        starts, runs = starts[found], runs[found]
        out.append((starts, np.full(len(starts), length), np.searchsorted(distinct, runs)))
    return of, out


def _scan(index: BenchmarkIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in tk.texts_in(batches, tk.NOT_ALNUM):
            n = len(rows)
            of, found = hits(words, index)
            per_text: list[set[int]] = [set() for _ in range(n)]
            mark = np.zeros(len(words) + 1, np.int64)
            for starts, lengths, at in found:
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + lengths, -1)
                distinct, offsets, items = index.by_length[int(lengths[0])] if len(starts) else (None, None, None)
                for t, h in set(zip(of[starts].tolist(), at.tolist(), strict=True)) if len(starts) else ():
                    per_text[t].update(items[offsets[h] : offsets[h + 1]].tolist())
            hit = np.cumsum(mark)[:-1] > 0
            edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            from_, to = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            spans: list[list[int]] = [[] for _ in range(n)]
            for a, b in zip(from_.tolist(), to.tolist(), strict=True):
                while a < b:  # a run of hit words may go on over the end of its text
                    t = int(of[a])
                    e = min(b, int(words.first[t + 1]))
                    spans[t] += [a - int(words.first[t]), e - int(words.first[t])]
                    a = e
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(c) for c in rows.schema.names if c != "text"],
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array([sorted({index.items[i] for i in s}) for s in per_text], pa.list_(pa.string())),
                ],
                names=[*[c for c in rows.schema.names if c != "text"], "n_words", "spans", "items"],
            )

    return run


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """Items with text as (part, item, text), staged, and how many parts there are: as many as hold
    ``part_bytes`` each. Items are dealt to parts by their hash, so parts are of like size, and the
    driver only ever holds one. A single item larger than a part is held as a whole."""
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    size = rows.agg(F.sum(F.char_length("text").cast("long") * 4).alias("n")).first().n or 0
    many = max(1, -(-size // part_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(many)).alias("part"), "item", "text")
    return stage(dealt.repartition("part"), "leaks-items"), many


def _index(items: DataFrame, part: int) -> BenchmarkIndex:
    own = items.filter(F.col("part") == part).select("item", "text").orderBy("item", "text").collect()  # one part, so bounded
    return BenchmarkIndex([r.item for r in own], [r.text for r in own])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, n_words long, spans array<int> (flat
    pairs of first and one-past-last word of each hit run) and items array<string>.

    Words are lower-cased A-Z and made of digits, ASCII letters and anything beyond ASCII. A run of
    10 words of an item, or a whole item of fewer, counts wherever it occurs in a document. Null or
    empty texts have no words; null item ids or texts are left out; items without words never
    match. Repeated rows give repeated results. Empty tables give no rows, or no hits. Equality is
    that of 64-bit hashes of word runs.

    Nothing is shuffled when the benchmark fits one part. Otherwise the rows are staged with a
    number each; the parts are searched one after another, each part's index sent and its hits
    staged before the next is built, and the spans of a row are merged by its number, so results do
    not depend on the parts. Only rows with hits are merged.
    """
    more = "n_words long, spans array<int>, items array<string>"
    items, many = benchmark_parts(benchmark, part_bytes)
    spark = docs.sparkSession
    ship(spark)

    def search(rows: DataFrame, part: int, names) -> tuple[DataFrame, Broadcast]:
        index = spark.sparkContext.broadcast(_index(items, part))
        return map_arrow(rows, lambda batches: _scan(index.value)(batches), with_fields(rows, names, more)), index

    rows = docs.select(*keep, *([] if "_row" in keep else ["text"]))
    if many == 1:
        return search(rows, 0, keep)[0]
    rows = stage(rows.withColumn(_NUMBER, F.monotonically_increasing_id()), "leaks-rows")
    texts = rows.select(_NUMBER, F.col("_row.text" if "_row" in keep else "text").alias("text"))
    hit, words = [], None
    for part in range(many):
        found, index = search(texts, part, (_NUMBER,))
        found = stage(found, "leaks-part") if part == 0 else stage(found.filter(F.size("spans") > 0), "leaks-part")
        index.destroy()
        words = found.select(_NUMBER, "n_words") if part == 0 else words
        hit.append(found.filter(F.size("spans") > 0).select(_NUMBER, "spans", "items"))
    merged = reduce(DataFrame.unionByName, hit).groupBy(_NUMBER).agg(F.flatten(F.collect_list("items")).alias("items"), F.collect_list("spans").alias("_all"))
    merged = merged.select(_NUMBER, _merge_spans(F.col("_all")).alias("spans"), F.array_distinct("items").alias("items"))
    whole = rows.select(_NUMBER, *keep).join(words, _NUMBER).join(merged, _NUMBER, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return whole.select(*keep, "n_words", none("spans", "int"), none("items", "string"))


def _merge_spans(lists):
    pair = lambda s: F.transform(F.sequence(F.lit(0), (F.size(s) / 2).cast("int") - 1), lambda i: F.struct(F.get(s, (2 * i).cast("int")).alias("a"), F.get(s, (2 * i + 1).cast("int")).alias("b")))
    pairs = F.array_sort(F.flatten(F.transform(lists, lambda s: F.when(F.size(s) > 0, pair(s)).otherwise(F.array().cast("array<struct<a:int,b:int>>")))))
    zero = F.struct(F.lit(-1).alias("to"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        fresh = p["a"] > acc["to"]
        grown = F.when(p["b"] > acc["to"], F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(p["b"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["to"], p["b"]).alias("to"), F.when(fresh, F.concat(acc["out"], F.array(p["a"], p["b"]))).otherwise(grown).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def n_hit(spans: str = "spans"):
    """Words in spans: ends less starts."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark span occurs."""
    found = contaminated_spans(as_row(docs), benchmark, ("_row",), part_bytes)
    return from_row(found.filter(F.size("spans") == 0), docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
