"""Toxicity: a support vector machine over a gappy subsequence string kernel with Nystrom landmarks.

A text is the set of its segments: words, where runs of words of one character, as in spaced-out
insults, are one segment. The kernel of two segments sums over their common subsequences of three letters,
each weighted by ``DECAY`` to the power of the length it spans, so gaps and inserted characters
cost little; characters that are no letters count as gaps. A text's similarity to a landmark is the
greatest over its segments. The Nystrom map of these similarities gives the features on which a
linear machine is trained with labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm import tokens as tk
from collatrix.llm.common import held_out, map_arrow, ship, table, text_or_empty

THRESHOLD = 0.5
DECAY = 0.7
#: Most characters that a subsequence may span.
SPAN = 8
#: Normalised kernel values up to this count as no similarity.
FLOOR = 0.5
#: Longer segments are cut into overlapping windows, so that an insult in one isn't drowned.
WIDTH, STRIDE = 24, 12
#: Toxic training texts that hold a telling word at least.
LEAST = 3
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 128, 32
#: Labelled texts of each class that landmarks and machine are fitted on at most: those whose ids have the
#: least hashes.
TRAIN_ROWS = 2500

#: Letters 1..26, bytes beyond ASCII 28..31; anything else, digits too, is a gap.
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 28 + np.arange(128) % 4
#: Bytes of the character that a byte begins.
_BYTES = np.ones(256, np.int64)
_BYTES[192:224], _BYTES[224:240], _BYTES[240:] = 2, 3, 4
FAR_SLOTS = 1 << 20
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_VALID = np.zeros(1 << 15, np.float32)
_all = np.arange(1 << 15)
_VALID[(_all >> 10 > 0) & (_all >> 5 & 31 > 0) & (_all & 31 > 0)] = 1


class Segments:
    """Distinct segments of a chunk of texts, as one row of letter codes with gaps of ``SPAN`` zeros
    between them (``codes``, the windows of segment i from ``first[i]``), and where they occur."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = tk.Words(data, offsets, tk.SPACE)
        self.data, self.n_texts = words.data, len(offsets) - 1
        of = tk.owner(words.first, len(words))
        single = words.end - words.start == _BYTES[self.data[words.start]]
        joins = np.zeros(len(words), bool)
        joins[1:] = single[1:] & single[:-1] & (of[1:] == of[:-1])
        head = np.flatnonzero(~joins)
        tail = np.append(head[1:], len(words)) - 1
        if len(head):
            turn = np.arange(len(words)) - np.repeat(head, np.diff(np.append(head, len(words))))
            key = np.add.reduceat(words.hash * tk.powers(tk._BASE, int(turn.max()) + 1)[turn], head)
        else:
            key = np.zeros(0, tk.U)
        start, end = words.start[head], words.end[tail] if len(head) else np.zeros(0, np.int64)
        self.key, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.occurs, self.text = inverse, of[head]
        self.start, self.end = start[index], end[index]

    def cut(self, which: np.ndarray) -> None:
        """Lay windows over the segments ``which``."""
        length = (self.end - self.start)[which]
        n_windows = np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1)
        self.segment = np.repeat(which, n_windows)
        turn = np.arange(len(self.segment)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        self.at = self.start[self.segment] + turn * STRIDE
        self.size = np.minimum(WIDTH, self.end[self.segment] - self.at)


def _lay_out(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows one after another, each followed by ``SPAN`` gaps, and their first places."""
    room = size + SPAN
    first = np.cumsum(room) - room
    total = int(room.sum())
    place = np.arange(total) - np.repeat(first, room)
    inside = place < np.repeat(size, room)
    codes = np.zeros(total + SPAN, np.int32)
    codes[:total][inside] = _CODE[data[(np.repeat(at, room) + place)[inside]]]
    return codes, first


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """For each pair of offsets, the code of the three letters from every place, and its weight."""
    n = len(codes) - SPAN
    high = codes[:n] << 10
    for a, b in _OFFSETS:
        yield high | (codes[a : a + n] << 5) | codes[b : b + n], np.float32(DECAY ** (b + 1))


def _sparse(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (window, triple) with summed weights: the windows' vectors in the kernel's space."""
    window = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes) - SPAN)))
    keys, weights = [], []
    for code, w in _triples(codes):
        hit = np.flatnonzero(_VALID[code])
        keys.append(window[hit] << 15 | code[hit])
        weights.append(np.full(len(hit), w, np.float32))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> 15, key & 0x7FFF, np.bincount(inverse, np.concatenate(weights), len(key)).astype(np.float32)


def vectors(strings: list[bytes]) -> np.ndarray:
    """Unit vectors of whole strings in the space of triples (few strings: landmarks)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    rows, triple, weight = _sparse(*_lay_out(tk.LOWER[data], np.cumsum(size) - size, size))
    out = np.zeros((len(strings), 1 << 15), np.float32)
    out[rows, triple] = weight
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


@dataclass
class Machine:
    """Landmarks' unit vectors over the triples they hold, and the linear machine over similarities
    (with the Nystrom map folded in)."""

    strings: list[bytes]
    weights: np.ndarray
    bias: float
    slope: float

    def __post_init__(self) -> None:
        full = vectors(self.strings) if self.strings else np.zeros((0, 1 << 15), np.float32)
        held = np.flatnonzero(full.any(0))
        self.place = np.full(1 << 15, -1, np.int32)
        self.place[held] = np.arange(len(held))
        self.table = np.ascontiguousarray(full[:, held].T)
        self.most = np.zeros(1 << 15, np.float32)
        self.most[held] = self.table.max(1) if self.strings else 0
        self.far = None

    def windows(self, found: Segments) -> tuple[np.ndarray, np.ndarray]:
        """(window, similarities) of the windows that are over ``FLOOR`` near some landmark. The greatest
        weight of each triple in any landmark bounds a window's similarity, so the rest is skipped."""
        codes, first = _lay_out(found.data, found.at, found.size)
        bound, norm = np.zeros(len(codes) - SPAN, np.float32), np.zeros(len(codes) - SPAN, np.float32)
        for code, w in _triples(codes):
            bound += w * self.most[code]
            norm += w * w * _VALID[code]
        near = np.flatnonzero(np.add.reduceat(bound, first) > FLOOR * np.sqrt(np.add.reduceat(norm, first)) + 1e-9) if len(first) else first
        if not len(near):
            return near, np.zeros((0, len(self.strings)), np.float32)
        window, triple, weight = _sparse(*_lay_out(found.data, found.at[near], found.size[near]))
        length = np.sqrt(np.bincount(window, weight**2, len(near)))
        known = self.place[triple] >= 0
        window, triple, weight = window[known], triple[known], weight[known]
        out = np.zeros((len(near), len(self.strings)), np.float32)
        for at in range(0, len(window), 1 << 16):  # rows of one window may be cut; sums add up
            w = window[at : at + (1 << 16)]
            edge = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[edge]] += np.add.reduceat(self.table[self.place[triple[at : at + (1 << 16)]]] * weight[at : at + (1 << 16), None], edge)
        return near, out / np.maximum(length, 1e-9)[:, None].astype(np.float32)

    def similarities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, the greatest similarity to each landmark, from 0 (at ``FLOOR``) to 1."""
        found = Segments(data, offsets)
        out = np.zeros((found.n_texts, len(self.strings)), np.float32)
        if self.far is None:  # segments lately found far from all landmarks, by the low bits of their hashes
            self.far = np.zeros(FAR_SLOTS, tk.U)
        slot = (found.key & tk.U(FAR_SLOTS - 1)).astype(np.int64)
        found.cut(np.flatnonzero(self.far[slot] != found.key))
        near, values = self.windows(found)
        values = np.maximum(0, (values - FLOOR) / (1 - FLOOR))
        alive = values.any(1)
        near, values = near[alive], values[alive]
        far = np.ones(len(found.key), bool)
        far[found.segment[near]] = False
        self.far[slot[far]] = found.key[far]
        if not len(near):
            return out
        segment = found.segment[near]  # ascending
        edge = np.flatnonzero(np.diff(segment, prepend=-1))
        values, segment = np.maximum.reduceat(values, edge), segment[edge]
        row = np.full(len(found.start), -1)
        row[segment] = np.arange(len(segment))
        occurs = np.flatnonzero(row[found.occurs] >= 0)
        pairs = np.unique(found.text[occurs] * len(segment) + row[found.occurs[occurs]])
        text, which = pairs // len(segment), pairs % len(segment)
        for at in range(0, len(pairs), 1 << 14):
            t = text[at : at + (1 << 14)]
            edge = np.flatnonzero(np.diff(t, prepend=-1))
            out[t[edge]] = np.maximum(out[t[edge]], np.maximum.reduceat(values[which[at : at + (1 << 14)]], edge))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, hi in tk.chunks(offsets):
            near = self.similarities(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out[lo:hi] = near @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * out, -500, 500)))


def landmarks(texts: list[str], toxic: np.ndarray) -> list[bytes]:
    """Segments that tell toxic texts from others, unlike one another, and some common plain ones."""
    data, offsets = tk.utf8(pa.array(texts, pa.large_string()))

    def chunks() -> Iterator[tuple[tk.Words, np.ndarray, np.ndarray]]:
        """Words, which of them are long enough, and the texts of those, a chunk at a time."""
        for lo, hi in tk.chunks(offsets):
            words = tk.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tk.NOT_ALNUM)
            usable = np.flatnonzero(words.end - words.start >= 3)
            yield words, usable, lo + tk.owner(words.first, len(words))[usable]

    held, long = [], []  # (hash, in a toxic text) once a text; hashes of words of 4 bytes and more
    for words, usable, of in chunks():
        order = np.lexsort((words.hash[usable], of))
        h, t = words.hash[usable][order], of[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        held.append((h[fresh], toxic[t[fresh]]))
        long.append(np.unique(words.hash[words.end - words.start >= 4]))
    hashes, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    in_toxic = np.concatenate([t for _, t in held])
    bad, good = np.bincount(inverse, in_toxic, len(hashes)), np.bincount(inverse, ~in_toxic, len(hashes))
    lift = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    expected = (bad + good) * toxic.mean()
    telling = np.flatnonzero((lift > 1.5) & (bad >= LEAST) & (bad - expected > 4 * np.sqrt(expected)))
    telling = telling[np.lexsort((hashes[telling], -(bad * lift)[telling]))][: 12 * TOXIC_LANDMARKS]
    plain = np.flatnonzero((lift < 0.5) & np.isin(hashes, np.concatenate(long)))  # short ones are near too much
    plain = plain[np.lexsort((hashes[plain], -(good + bad)[plain]))][: 12 * PLAIN_LANDMARKS]
    looked_for = np.sort(hashes[np.concatenate([telling, plain])])
    text_of: dict[int, bytes] = {}
    for words, usable, _ in chunks():
        h, index = np.unique(words.hash[usable], return_index=True)
        for i in np.flatnonzero(np.isin(h, looked_for)):
            w = usable[index[i]]
            text_of.setdefault(int(h[i]), words.data[words.start[w] : words.end[w]].tobytes()[:WIDTH])

    def unlike(order: np.ndarray, most: int) -> list[bytes]:
        chosen, space = [], np.zeros((most, 1 << 15), np.float32)
        for h in hashes[order].tolist():
            own = vectors([text_of[h]])[0]
            if own.any() and (space[: len(chosen)] @ own).max(initial=0) < 0.85:
                space[len(chosen)] = own
                chosen.append(text_of[h])
                if len(chosen) == most:
                    break
        return chosen

    found = unlike(telling, TOXIC_LANDMARKS)
    return found + [s for s in unlike(plain, PLAIN_LANDMARKS) if s not in found]


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 400) -> Machine:
    """Squared hinge loss on the Nystrom features, classes weighing alike, by accelerated gradient
    descent. With one class only, every text gets that class's side of the threshold."""
    if not toxic.any() or toxic.all():
        return Machine([], np.zeros(0), 1.0 if len(toxic) and toxic.all() else -1.0, 3.0)
    strings = landmarks(texts, toxic)
    blank = Machine(strings, np.zeros(len(strings)), 0.0, 1.0)
    data, offsets = tk.utf8(pa.array(texts, pa.large_string()))
    near = np.concatenate([blank.similarities(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in tk.chunks(offsets)]).astype(float)
    if not strings:
        return Machine([], np.zeros(0), -1.0, 3.0)
    own = vectors(strings)
    gram = np.maximum(0, (own @ own.T - FLOOR) / (1 - FLOOR)).astype(float)
    values, base = np.linalg.eigh(gram + 1e-2 * np.eye(len(strings)))
    root = (base / np.sqrt(np.maximum(values, 1e-3))) @ base.T  # the Nystrom map
    x = np.column_stack([near @ root, np.ones(len(near))])
    y = np.where(toxic, 1.0, -1.0)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    keep = np.full(x.shape[1], 1e-3)
    keep[-1] = 0
    step = 1 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) + keep.max())
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (-2 * x.T @ (weight * y * slack) + keep * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    values = x @ w
    high, low = np.quantile(values[~toxic], 0.998), np.quantile(values[toxic], 0.02)
    cut = high + 0.35 * (low - high) if low > high else 0.0  # texts with gaps score between the classes
    return Machine(strings, root @ w[:-1], float(w[-1] - cut), 4.0)


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts of each class that aren't held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pick = lambda c: known.filter(F.col("toxic") == c).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = pick(1).unionByName(pick(0))  # at most 2 * rows, so safe to broadcast
    found = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").collect()
    found.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in found], np.array([r.toxic == 1 for r in found], bool)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of each row of ``docs``, from its whole text.

    Learns from ``labels`` (doc_id, toxic 0/1) that are not held out, on at most ``TRAIN_ROWS``
    texts of each class; null ids and labels are left out, repeated ones count as often as they
    stand. Null or empty texts are scored as texts without segments. Repeated rows get equal
    scores. Without labels of both classes all texts get one score. Empty tables give no rows;
    other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(*training_texts(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(*tk.utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
