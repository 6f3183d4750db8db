"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words, and two are near if one word inserted, deleted or replaced makes them
equal. Each line that can have a near one emits its variants with one word left out as hashed keys;
equal variants meet, the edit distance of the lines is verified, and the earliest line stays.

A line's place is (doc, tie, row, line): the id and a hash of the text order the documents, and the
staged number of the row, with the line number, is the identity, so equal or null ids share no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm import tokens as tk
from collatrix.llm.common import as_row, map_arrow, scope, ship, stage, table

#: Lines of fewer words, so blank ones, are never removed.
MIN_WORDS = 1
#: Shorter lines are only compared for equality: one word in seven or fewer is most often what a line
#: says ("Chapter 3", "Total: 7 items"), so another line and not a copy.
MIN_NEAR_WORDS = 8
#: Up to so many lines are picked from the texts with a broadcast list of 8 bytes each; more by a join.
BROADCAST_LINES = 2_000_000
_SECOND = 0xD1342543DE82EF95
_LENGTH = tk.U(0x2545F4914F6CDD1D)
_NULL_ID = (1 << 63) - 1
#: Where a line stands, in this order.
PLACE = ("doc", "tie", "row", "line")
_PLACE_TYPES = "doc long, tie long, row long, line int"


class Sequences:
    """Hashes of runs of consecutive words of a chunk, from running sums."""

    def __init__(self, hashes: np.ndarray, base: int = tk._BASE):
        n = len(hashes)
        self.total = np.zeros(n + 1, tk.U)
        np.cumsum(hashes * tk.powers(base, n), out=self.total[1:])
        self.inverse = tk.powers(pow(base, -1, 1 << 64), n + 2)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tk.mix(self.raw(a, b) + (b - a).astype(tk.U) * _LENGTH)

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of the words a..b less the word i, as ``hash`` would give it."""
        rest = (self.total[i] - self.total[a]) * self.inverse[a] + (self.total[b] - self.total[i + 1]) * self.inverse[a + 1]
        return tk.mix(rest + (b - a - 1).astype(tk.U) * _LENGTH)


class Lines:
    """Lines of a chunk of texts: text, number in it, byte range and word range of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = tk.Words(data, offsets, tk.SPACE)
        breaks = np.flatnonzero(data == 10)
        text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((start, text))
        self.text, self.start = text[order], start[order]
        self.end = np.append(self.start[1:] - 1, 0)
        last = np.append(np.flatnonzero(np.diff(self.text)), len(self.text) - 1) if len(self.text) else np.zeros(0, np.int64)
        self.end[last] = offsets[1:][self.text[last]]
        first = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.number = np.arange(len(self.text)) - first[self.text]
        self.a = np.searchsorted(self.words.start, self.start)
        self.b = np.searchsorted(self.words.start, self.end)


def _position(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(row.astype(np.int64).view(tk.U)) + line.astype(np.int64).view(tk.U))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(min_words: int, min_near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each line of ``min_words`` or more: 128 bits of hash, place, words, and keys of its halves.

        If two lines are one word apart, they share the first or the last ceil((n - 1) / 2) words (n
        the longer's count), so lines that share no such half with any other need no variants.
        """
        for batch in batches:
            data, offsets = tk.utf8(batch.column("text"))
            places = [np.array(batch.column(c)) for c in PLACE[:3]]
            for lo, hi in tk.chunks(offsets):
                lines = Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                pick = np.flatnonzero(lines.b - lines.a >= min_words)
                a, b = lines.a[pick], lines.b[pick]
                one, two = Sequences(lines.words.hash), Sequences(tk.mix(lines.words.hash), _SECOND)
                n = b - a
                keys = []
                for half in (n // 2, (n + 1) // 2):  # ceil((n - 1) / 2) as the longer or equal, ceil(n / 2) as the shorter
                    tag = (half.astype(tk.U) << tk.U(1)) * _LENGTH
                    keys += [tk.mix(one.raw(a, a + half) + tag), tk.mix(one.raw(b - half, b) + tag + tk.U(1))]
                flat = np.stack(keys, 1).view(np.int64)
                used = np.zeros(flat.shape, bool)
                near = n >= min_near
                used[near, :2] = True
                used[near & (n % 2 == 1), 2:] = True
                sizes = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_long(one.hash(a, b)), _long(two.hash(a, b)), *[pa.array(c[lo:hi][lines.text[pick]]) for c in places], pa.array(lines.number[pick].astype(np.int32)), pa.ListArray.from_arrays(sizes, flat[used])],
                    names=["h1", "h2", *PLACE, "halves"],
                )

    return run


def _picked(wanted):
    """Lines of the texts at wanted places: from a sorted array of place hashes, or column ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column("text"))
            rows = np.array(batch.column("row"))
            lists = None if wanted else batch.column("lines")
            for lo, hi in tk.chunks(offsets):
                lines = Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row = rows[lo:hi][lines.text]
                if wanted:
                    places, at = wanted.value, _position(row, lines.number)
                    found = np.searchsorted(places, at)
                    found[found == len(places)] = 0
                    pick = np.flatnonzero(places[found] == at)
                else:
                    first = np.searchsorted(lines.text, np.arange(hi - lo))
                    pick = np.array([first[i] + j for i in range(hi - lo) for j in lists[lo + i].as_py()], np.int64)
                raw = data[offsets[lo] : offsets[hi]]
                texts = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(lines.start[pick].tolist(), lines.end[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row[pick]), pa.array(lines.number[pick].astype(np.int32)), pa.array(texts, pa.string())], names=["row", "line", "text"])

    return run


def pick_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(row, line, text) of the lines at ``places`` (row, line) in ``docs`` (row, text)."""
    ship(docs.sparkSession)
    if places.count() <= BROADCAST_LINES:
        def hashed(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([_long(_position(np.array(b.column("row")), np.array(b.column("line"))))], names=["at"])

        at = map_arrow(places.select("row", "line"), hashed, "at long").toPandas()["at"].to_numpy(np.int64).view(tk.U)
        if not len(at):
            return docs.sparkSession.createDataFrame([], "row long, line int, text string")
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(at))
        return map_arrow(docs.select("row", "text"), _picked(wanted), "row long, line int, text string")
    lists = places.groupBy("row").agg(F.collect_list("line").alias("lines"))
    return map_arrow(docs.select("row", "text").join(lists, "row"), _picked(None), "row long, line int, text string")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line, itself (at -1) and, for every word that may be the one that differs, the rest of
    the line: key, at and its place. A shared first half leaves only words of the second, and so on."""
    for batch in batches:
        data, offsets = tk.utf8(batch.column("text"))
        columns = [np.array(batch.column(c)) for c in ("first_half", "last_half", *PLACE)]
        for lo, hi in tk.chunks(offsets, tk.CHUNK_BYTES // 4):
            words = tk.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tk.SPACE)
            runs = Sequences(words.hash)
            first_half, last_half, *place = [c[lo:hi] for c in columns]
            of = tk.owner(words.first, len(words))
            a, b = words.first[:-1][of], words.first[1:][of]
            i = np.arange(len(words))
            half = (b - a) // 2
            may = (first_half[of] & (i - a >= half)) | (last_half[of] & (b - 1 - i >= half))
            pick = np.flatnonzero(may)
            key = np.concatenate([runs.hash(words.first[:-1], words.first[1:]), runs.without(a[pick], b[pick], pick)])
            at = np.concatenate([np.full(hi - lo, -1), (i - a)[pick]]).astype(np.int32)
            who = np.concatenate([np.arange(hi - lo), of[pick]])
            yield pa.RecordBatch.from_arrays([_long(key), pa.array(at), *[pa.array(c[who]) for c in place]], names=["key", "at", *PLACE])


def one_apart(x: list[str], y: list[str]) -> bool:
    """Whether the word sequences differ by at most one insertion, deletion or replacement."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_words(text: str) -> list[str]:
    """Words between spaces and tabs, A-Z lower-cased."""
    return [w for w in text.translate(_LOWER).replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [one_apart(line_words(x), line_words(y)) for x, y in zip(b.column("text").to_pylist(), b.column("other").to_pylist(), strict=True)]
        yield b.select(["row", "line"]).filter(pa.array(good, pa.bool_()))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_near: int = MIN_NEAR_WORDS) -> DataFrame:
    """(row, line) of the lines to remove from ``docs`` (doc, tie, row, text; ``row`` is unique): those
    equal to or one word apart from an earlier line, by place. Of exact copies the first stands for all."""
    with scope(remove=False) as staged:
        lines = stage(map_arrow(docs, _scan(min_words, min_near), f"h1 long, h2 long, {_PLACE_TYPES}, halves array<long>"), "lines")
        place = F.struct(*PLACE)
        distinct = stage(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")), "lines-distinct")
        staged.drop(keep=[distinct, lines])

        halves = distinct.filter(F.size("halves") > 0).select("first.row", "first.line", F.posexplode("halves").alias("which", "half"))
        shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
        flag = lambda odd: F.max(F.col("which") % 2 == odd)
        chosen = halves.join(shared, "half").groupBy("row", "line").agg(flag(0).alias("first_half"), flag(1).alias("last_half"))
        chosen = stage(chosen.join(distinct.select("first.*"), ["row", "line"]), "lines-chosen")
        texts = stage(pick_lines(docs, chosen).join(chosen, ["row", "line"]), "lines-texts")
        variants = stage(map_arrow(texts, _variants, f"key long, at int, {_PLACE_TYPES}"), "lines-variants")
        staged.drop(keep=[distinct, lines, texts, variants])

        # Replaced words: lines with one variant at one place are all one word apart from the first of them.
        left_out = variants.filter("at >= 0")
        groups = left_out.groupBy("key", "at").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        replaced = left_out.join(groups, ["key", "at"]).filter(place > F.col("first")).select(place.alias("place"), F.col("first").alias("other"))
        # Inserted words: a line that is a variant of another.
        whole = variants.filter("at < 0").select("key", place.alias("whole"))
        inserted = left_out.join(whole, "key").select(F.greatest(place, "whole").alias("place"), F.least(place, "whole").alias("other"))
        pairs = replaced.unionByName(inserted).filter("place != other").distinct()

        lookup = texts.select("row", "line", "text")
        pairs = pairs.select("place.row", "place.line", F.col("other.row").alias("row2"), F.col("other.line").alias("line2"))
        both = pairs.join(lookup, ["row", "line"]).join(lookup.toDF("row2", "line2", "other"), ["row2", "line2"])
        near = stage(map_arrow(both.select("row", "line", "text", "other"), _verify, "row long, line int").distinct(), "lines-near")
        staged.drop(keep=[distinct, lines, near])

        marked = distinct.select("h1", "h2", "n", "first.row", "first.line").join(near.withColumn("near", F.lit(True)), ["row", "line"], "left")
        marked = marked.filter("n > 1 or near").select("h1", "h2", F.struct("row", "line").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
        gone = lines.select("h1", "h2", "row", "line").join(marked, ["h1", "h2"]).filter(F.col("near") | (F.struct("row", "line") != F.col("first")))
        gone = stage(gone.groupBy("row").agg(F.collect_set("line").alias("lines")), "lines-gone")
        staged.drop(keep=[gone])
        return gone


def cut_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_near: int = MIN_NEAR_WORDS) -> DataFrame:
    """Each row of ``docs`` as ``_row``, with ``_cut``, its text less repeated lines, and ``_removed``, how
    many went. Whatever the columns of ``docs`` are called, they clash with nothing.

    Lines end at newlines; words are between white space, A-Z lower-cased. A line of ``min_words``
    or more goes if an earlier line, by (doc_id, line number), equals it or, from ``min_near``
    words on, is one word apart; links are not followed further, so in a chain each line but the
    first goes. Blank lines stay. Lines of the same document count too. Every row is a document of
    its own: rows of one doc_id are ordered by a hash of their text, and null ids come last. Null
    text stays null; a text that loses all its lines becomes empty. Empty tables give no rows. Rows
    are staged once, so that their numbers hold. Line lists are per row, so bounded by it, and a
    text is put together in time linear in its lines.
    """
    rows = stage(as_row(docs).withColumn("_n", F.monotonically_increasing_id()), "lines-rows")
    text = F.col("_row.text")
    doc = F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_NULL_ID))
    gone = removed_lines(rows.select(doc.alias("doc"), F.xxhash64(text).alias("tie"), F.col("_n").alias("row"), text.alias("text")), min_words, min_near)
    found = rows.join(gone.toDF("_n", "_lines").hint("merge"), "_n", "left")  # one plan at every size

    def kept(cell):  # bound once, as lines are looked up by number
        held = F.array_except(F.sequence(F.lit(0), F.size(cell["lines"]) - 1), cell["gone"])
        return F.array_join(F.transform(held, lambda i: F.get(cell["lines"], i)), "\n")

    both = F.struct(F.split(text, "\n", -1).alias("lines"), F.col("_lines").alias("gone"))
    changed = F.when(F.col("_lines").isNull() | text.isNull(), text).otherwise(F.get(F.transform(F.array(both), kept), F.lit(0)))
    return found.select("_row", changed.alias("_cut"), F.coalesce(F.size("_lines"), F.lit(0)).alias("_removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_near: int = MIN_NEAR_WORDS) -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of ``text`` as by ``cut_lines``, and ``_removed``,
    how many (a column of that name gives way)."""
    columns = [F.col("_cut").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c != "_removed"]
    return cut_lines(docs, min_words, min_near).select(*columns, "_removed")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("_removed").cast("long").alias("n_removed"))
