"""N-gram Jaccard join with set-relation skipping.

Documents are sets of 5-word shingles, each ordered by a global order (frequent shingles last), and
only prefixes are indexed. Index lists are cut into blocks by size and place, and two blocks are
skipped as a whole, before any pair is made, where sizes and places leave no room for enough
overlap; pairs whose sketches already differ in too many bits go at once. Answers are derived from those of similar sets: equal sets share one node; in every list
sets are first compared with few pivots; a set's closest answered set then leads it. What the
leaders of two sets have in common, with how far the sets are from their leaders, bounds what the
sets have in common, so most remaining pairs are answered without comparing them, from one answer
for all that the two leaders lead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.llm import tokens as tk
from collatrix.llm.common import as_row, from_row, map_arrow, scope, ship, stage, table
from collatrix.llm.components import merge_components
from collatrix.staging import Staged

WORDS = 5
#: Shingles in more documents come last in the order; raised if the list would pass FREQUENT_MOST entries.
FREQUENT = 32
FREQUENT_MOST = 4_000_000
#: Entries of the index, or of the counts, that one group handles.
GROUP_ENTRIES = 1_000_000
LEAST_GROUPS = 64
#: Rounds of comparing with pivots, pivots of a list in a round, and pivots that a set is compared with.
ROUNDS = 3
PIVOTS = 6
PROPOSALS = 2
#: Partners, those it shares most lists with, that a set is compared with before all that are left.
CLOSEST = 4
#: A pivot is worth comparing with if it shares one in so many shingles of the prefix.
LIKELY = 8
#: Lists up to this length are compared together with others of their length.
SHORT_LIST = 32
#: Entries of the longest list that one task takes as a whole; longer ones are cut into blocks of about
#: this size, and pairs of blocks are dealt to the tasks.
BLOCK = 4096
#: Entries of a block that are skipped together, and the step of sizes that share a block.
SUB_BLOCK = 128
SIZE_STEP = 1.15
#: Bits of a set's sketch.
SKETCH = 512
#: Documents of a shingle above which its entries are gathered in several parts.
HOT = 200_000
#: Nodes up to which a filter is broadcast (24 bytes each); beyond it is an ordinary join.
BROADCAST_NODES = 1_000_000
_RESIDUAL = 24


def overlap_needed(n, m):
    """Least intersection with 100 * intersection >= 75 * union."""
    return -(-3 * (n + m) // 7)


def prefix(n):
    """Shingles of which one at least is shared with any linked set, whatever its size."""
    return n - -(-3 * n // 4) + 1


class Sets:
    """Shingle sets of a chunk of texts: sorted distinct hashes, those of text i from first[i]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int = WORDS):
        words = tk.Words(data, offsets, tk.SPACE)
        count = np.diff(words.first)
        n_texts = len(count)
        of = tk.owner(words.first, len(words))
        place = np.arange(len(words)) - words.first[of] if len(words) else np.zeros(0, np.int64)
        full = np.flatnonzero(place + k <= count[of]) if len(words) else np.zeros(0, np.int64)
        hashes, owner = [tk.grams(words.hash, k)[full]], [of[full]]
        for short in range(1, k):
            texts = np.flatnonzero(count == short)
            if len(texts):
                hashes.append(tk.grams(words.hash, short)[words.first[texts]])
                owner.append(texts)
        h, t = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(h)
        h, t = h[order], t[order]
        order = np.argsort(t.astype(np.uint16) if n_texts < 1 << 16 else t, kind="stable")
        h, t = h[order], t[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        self.hash, self.text = h[fresh], t[fresh]
        self.size = np.bincount(self.text, minlength=n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.zeros(len(self.hash) + 1, tk.U)
        np.cumsum(tk.mix(self.hash + tk.U(0x51ED270B)), out=total[1:])
        self.node = tk.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(tk.U)).view(np.int64)


    def sketches(self) -> np.ndarray:
        """Of each set, the parities of how many shingles fall into each of ``SKETCH`` bits: two sets differ
        in at least as many shingles as their sketches do in bits."""
        key = np.sort(self.text * SKETCH + (self.hash & tk.U(SKETCH - 1)).astype(np.int64))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        odd = key[first[np.diff(np.append(first, len(key))) % 2 == 1]]
        out = np.zeros(len(self.size) * SKETCH // 8, np.uint8)
        np.bitwise_or.at(out, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
        return out.reshape(len(self.size), SKETCH // 8)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = tk.utf8(batch.column("text"))
    for lo, hi in tk.chunks(offsets):
        yield lo, hi, Sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, sets in _chunks(batch):
            rows = batch.slice(lo, hi - lo)
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 8), hi - lo, [None, pa.py_buffer(sets.sketches())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("mark"), pa.array(sets.size.astype(np.int64)), pa.array(sets.node), sketch], names=["doc_id", "mark", "n", "node", "sketch"])


def _blobs(groups: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row a group with the bytes of its entries, which are sorted by group."""
    edge = np.flatnonzero(np.diff(groups, prepend=-1))
    ends = np.append(edge[1:], len(groups))
    cells = [[c[a:b].tobytes() for a, b in zip(edge.tolist(), ends.tolist(), strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(groups[edge].astype(np.int64)), *[pa.array(c, pa.binary()) for c in cells]], names=["group", *names])


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each shingle in some texts, packed by the top bits of its hash."""
        def packed() -> pa.RecordBatch:
            buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
            low = (buckets & tk.U((1 << _RESIDUAL) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            return _blobs((buckets >> tk.U(_RESIDUAL)).astype(np.int64), [np.ascontiguousarray(low), counts.astype(np.uint32)], ["low", "count"])

        parts, held = [], 0
        for batch in batches:
            for _, _, sets in _chunks(batch):
                parts.append(sets.hash >> tk.U(64 - bits - _RESIDUAL))
                held += len(sets.hash)
                if held > GROUP_ENTRIES:
                    yield packed()
                    parts, held = [], 0
        if held:
            yield packed()

    return run


def _frequent(least: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bytes_ = np.frombuffer(b"".join(rows.low), np.uint8).reshape(-1, 3).astype(np.uint32)
        low, inverse = np.unique(bytes_[:, 0] | bytes_[:, 1] << 8 | bytes_[:, 2] << 16, return_inverse=True)
        total = np.bincount(inverse, np.frombuffer(b"".join(rows["count"]), np.uint32))
        keep = total > least
        return pd.DataFrame({"bucket": (key[0] << _RESIDUAL) + low[keep].astype(np.int64), "n": total[keep].astype(np.int64)})

    return run


class Frequent:
    """Which hashes are frequent, by their top bits: a bitmap first, then the sorted list. ``parts``: into
    how many parts the entries of each are gathered."""

    def __init__(self, buckets: np.ndarray, counts: np.ndarray, bits: int):
        self.shift = 64 - bits - _RESIDUAL
        order = np.argsort(buckets)
        self.buckets, self.parts = buckets[order], -(-counts[order] // HOT)
        self.hot = bool((self.parts > 1).any())
        self.map = np.zeros(1 << 22, bool)
        self.map[self.buckets & ((1 << 22) - 1)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> tk.U(self.shift)).astype(np.int64)
        out = self.map[bucket & ((1 << 22) - 1)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.searchsorted(self.buckets, bucket[maybe])
            at[at == len(self.buckets)] = 0
            out[maybe] = self.buckets[at] == bucket[maybe]
        return out

    def part(self, hashes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The part, from 1, that a node's entry of a hot shingle goes to; 0 for other shingles."""
        at = np.searchsorted(self.buckets, (hashes >> tk.U(self.shift)).astype(np.int64))
        at[at == len(self.buckets)] = 0
        many = np.where(self(hashes), self.parts[at], 1)
        return np.where(many > 1, 1 + (tk.mix(nodes.view(tk.U)) % many.astype(tk.U)).astype(np.int64), 0)


def _entries(frequent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes of the batch's distinct sets, packed by the top bits of the shingle (for hot shingles
        by those of the shingle and its part, as a negative group): shingle, place, size and node."""
        for batch in batches:
            seen: set[int] = set()
            for _, _, sets in _chunks(batch):
                use = np.zeros(len(sets.size), bool)
                for i, (node, n) in enumerate(zip(sets.node.tolist(), sets.size.tolist(), strict=True)):
                    if n and node not in seen:
                        seen.add(node)
                        use[i] = True
                last = frequent.value(sets.hash)
                order = np.lexsort((last, sets.text)) if last.any() else slice(None)  # stable: by hash within
                h, t = sets.hash[order], sets.text[order]
                place = np.arange(len(h)) - sets.first[t]
                pick = np.flatnonzero((place < prefix(sets.size)[t]) & use[t])
                h, t, place = h[pick], t[pick], place[pick]
                group = (h >> tk.U(64 - bits)).astype(np.int64)
                if frequent.value.hot and len(h):
                    part = frequent.value.part(h, sets.node[t])
                    group = np.where(part > 0, -1 - (tk.mix(h + part.astype(tk.U)) >> tk.U(2)).astype(np.int64), group)
                order = np.argsort(group, kind="stable")
                h, t, place, group = h[order], t[order], place[order], group[order]
                if len(h):
                    yield _blobs(group, [h, place.astype(np.uint32), sets.size[t].astype(np.uint32), sets.node[t]], ["low", "place", "size", "node"])

    return run


def _lists(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Index lists of two sets or more of the group, one row an entry. A part of a hot list is kept as it is."""
    joined = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
    low, place, size, node = joined("low", np.int64), joined("place", np.uint32), joined("size", np.uint32), joined("node", np.int64)
    order = np.lexsort((node, low))
    low, place, size, node = low[order], place[order], size[order], node[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
    low, place, size, node = low[fresh], place[fresh], size[fresh], node[fresh]
    same = low[1:] == low[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (key[0] < 0)
    return pd.DataFrame({"list": low[shared], "node": node[shared], "size": size[shared].astype(np.int32), "place": place[shared].astype(np.int32)})


def _room(n, i, m, j):
    """Whether sets of sizes n and m that share a shingle at places i and j, and none before, can link."""
    need = overlap_needed(n, m)
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (n - i >= need) & (m - j >= need)


def _most(n, i, m, j):
    """The most that sets of sizes n and m which share a shingle at places i and j, whether or not it is
    their first, have in common: what stands before it in both, itself, and what stands behind."""
    return np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(batch.column(c)).astype(np.int64) for c in ("list", "node", "size", "place", "label", "weight")]


def _sketched(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [*_columns(batch), np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(batch), SKETCH // 64)]


def _star(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, pivot, size, n): in how many lists a pivot is next to a node of another component.

        A pivot is the least, under a random order that is the same for all lists, of the nodes of
        a list's largest component (``weight`` is its size), so few nodes are pivots and a family
        of similar sets meets the same ones everywhere. The first pivot is the one with the most
        links so far (``degree``): it stands in the middle of its component, so that components of
        one family find one another."""
        for batch in batches:
            key, node, size, place, label, weight = _columns(batch)
            if not len(key):
                continue
            degree = np.minimum(np.array(batch.column("degree")).astype(np.int64), (1 << 23) - 1).astype(tk.U)
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            heavy = weight == np.maximum.reduceat(weight, first)[of]
            for turn in range(PIVOTS):
                draw = tk.mix(node.view(tk.U) + tk.U(salt * PIVOTS + turn + 1)) >> tk.U(1)
                if turn == 0:
                    draw = (tk.U((1 << 23) - 1) - degree << tk.U(40)) | (draw >> tk.U(24))
                draw = np.where(heavy, draw, tk.U((1 << 64) - 1))
                at = np.flatnonzero(draw == np.minimum.reduceat(draw, first)[of])
                pivot = np.zeros(len(first), np.int64)
                pivot[of[at]] = at
                p = pivot[of]
                pick = np.flatnonzero((label != label[p]) & (4 * np.minimum(size, size[p]) >= 3 * np.maximum(size, size[p])))
                order = pick[np.lexsort((node[p[pick]], node[pick]))]
                x, y = node[order], node[p[order]]
                edge = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(x[edge]), pa.array(y[edge]), pa.array(size[order[edge]]), pa.array(np.diff(np.append(edge, len(order))))], names=["node", "pivot", "size", "n"])

    return run


class _Overlaps:
    """Partial overlaps of sets with sets of other components, gathered pair by pair and passed on packed:
    of each probing set (node, size) the others' (node, size), how many lists they share, and how
    many of those at places that leave room for a link. The set of the smaller component probes."""

    def __init__(self) -> None:
        self.found: list[np.ndarray] = []
        self.rows = 0

    def keep(self, columns: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        _, node, size, place, label, weight, sketch = columns
        n, m, i, j = size[x], size[y], place[x], place[y]
        ok = (label[x] != label[y]) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
        ok &= _most(n, i, m, j) >= overlap_needed(n, m)
        x, y = x[ok], y[ok]
        apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
        ok = (size[x] + size[y] - apart) // 2 >= overlap_needed(size[x], size[y])
        x, y = x[ok], y[ok]
        swap = (weight[x] > weight[y]) | ((weight[x] == weight[y]) & (node[x] > node[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        self.found.append(np.stack([node[x], size[x], node[y], size[y], _room(size[x], place[x], size[y], place[y])], 1))
        self.rows += len(x)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.rows > 1 << 19:
            yield self.packed()

    def packed(self) -> pa.RecordBatch:
        rows = np.concatenate(self.found)
        self.found, self.rows = [], 0
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        edge = np.flatnonzero(np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])))
        shared, early = np.diff(np.append(edge, len(rows))), np.add.reduceat(rows[:, 4], edge)
        rows = rows[edge]
        probe = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        ends = np.append(probe[1:], len(rows))
        columns = [rows[:, 2], rows[:, 3].astype(np.int32), shared.astype(np.int32), early.astype(np.int32)]
        cells = [pa.array([c[a:b].tobytes() for a, b in zip(probe.tolist(), ends.tolist(), strict=True)], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(rows[probe, 0]), pa.array(rows[probe, 1]), *cells], names=["node", "size", "other", "other_size", "shared", "early"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.packed()


def _cut(columns: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Some entries of a list ordered by size step and place, the starts of their blocks, and of each block
    the least and greatest size, place and label."""
    _, node, size, place, label, *_ = columns
    step = np.floor(np.log(np.maximum(size[rows], 1)) / np.log(SIZE_STEP))
    rows = rows[np.lexsort((node[rows], place[rows], step))]
    first = np.arange(0, len(rows), SUB_BLOCK)
    bounds = [f(v[rows], first) for v in (size, place, label) for f in (np.minimum.reduceat, np.maximum.reduceat)]
    return rows, np.append(first, len(rows)), bounds


def _may_link(x: list, y: list):
    """Of blocks given by bounds (least and greatest size, place, label): whether any pair can link, of
    sets that aren't all of one component."""
    n0, n1, i0, i1, a0, a1 = x
    m0, m1, j0, j1, b0, b1 = y
    sizes = (4 * n1 >= 3 * m0) & (4 * m1 >= 3 * n0)
    most = np.minimum(i1, j1) + 1 + np.minimum(n1 - i0, m1 - j0) - 1
    return sizes & (most >= overlap_needed(n0, m0)) & ~((a0 == a1) & (b0 == b1) & (a0 == b0))


def _enumerate(columns: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, out: _Overlaps) -> Iterator[pa.RecordBatch]:
    """Pairs of entries of a list, of ``left`` among themselves or with ``right``, block by block."""
    x, xs, xb = _cut(columns, left)
    y, ys, yb = (x, xs, xb) if right is None else _cut(columns, right)
    may = _may_link([b[:, None] for b in xb], [b[None] for b in yb])
    if right is None:
        may = np.triu(may)
    for p, q in zip(*[c.tolist() for c in np.nonzero(may)], strict=True):
        a, b = x[xs[p] : xs[p + 1]], y[ys[q] : ys[q + 1]]
        if right is None and p == q:
            i, j = np.triu_indices(len(a), 1)
            out.keep(columns, a[i], a[j])
        else:
            out.keep(columns, np.repeat(a, len(b)), np.tile(b, len(a)))
        yield from out.full()


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps in lists of at most ``BLOCK`` entries, which come sorted by list. Lists of one
    short length are taken together."""
    out = _Overlaps()
    for columns in _whole_keys(batches, _sketched, []):
        key = columns[0]
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        length = np.diff(np.append(first, len(key)))
        for n in np.unique(length[(length > 1) & (length <= SHORT_LIST)]).tolist():
            i, j = np.triu_indices(n, 1)
            starts = first[length == n]
            step = max(1, (1 << 19) // len(i))
            for at in range(0, len(starts), step):
                out.keep(columns, (starts[at : at + step, None] + i).ravel(), (starts[at : at + step, None] + j).ravel())
                yield from out.full()
        for a, n in zip(first[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
            yield from _enumerate(columns, np.arange(a, a + n), None, out)
    yield from out.rest()


_FIELDS = ("node", "size", "place", "label", "weight")


def _pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a long list: its entries as bytes, and its bounds."""
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.int64).reshape(len(rows), SKETCH // 64)
    entries = np.ascontiguousarray(np.hstack([rows[list(_FIELDS)].to_numpy(np.int64), sketch]))
    bounds = {f"{c}{k}": [int(f(rows[c]))] for c in ("size", "place", "label") for k, f in enumerate((min, max))}
    return pd.DataFrame({"list": [key[0]], "step": [key[1]], "salt": [key[2]], "entries": [entries.tobytes()], **bounds})


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of the entries of pairs of blocks."""
    out = _Overlaps()
    for batch in batches:
        for i in range(len(batch)):
            sides = [np.frombuffer(batch.column(c)[i].as_py(), np.int64).reshape(-1, len(_FIELDS) + SKETCH // 64) for c in ("x", "y")]
            same = batch.column("same")[i].as_py()
            both = sides[0] if same else np.concatenate(sides)
            fields, sketch = both[:, : len(_FIELDS)], np.ascontiguousarray(both[:, len(_FIELDS) :]).view(np.uint64)
            columns = [np.zeros(len(both), np.int64), *np.ascontiguousarray(fields.T), sketch]
            left = np.arange(len(sides[0]))
            yield from _enumerate(columns, left, None if same else np.arange(len(left), len(both)), out)
    yield from out.rest()


def _long_lists(lists: DataFrame) -> DataFrame:
    """Overlaps in the lists of more than ``BLOCK`` entries. Such a list is cut into blocks by steps of
    size and, within a step, by a hash of the node into as many as its length asks for; pairs of
    blocks that may link are dealt to all tasks, so no task holds a list."""
    step = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(SIZE_STEP))).cast("int")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("length") / BLOCK)).cast("int")
    cut = lists.select("list", step.alias("step"), salt.alias("salt"), *_FIELDS, "sketch")
    bounds = ", ".join(f"{c}{k} long" for c in ("size", "place", "label") for k in (0, 1))
    blocks = stage(cut.groupBy("list", "step", "salt").applyInPandas(_pack_block, f"list long, step int, salt int, entries binary, {bounds}"), "near-blocks")
    side = lambda name: blocks.select("list", *[F.col(c).alias(f"{name}_{c}") for c in blocks.columns if c != "list"])
    x, y = side("x"), side("y")
    n0, n1, i0, i1, a0, a1 = [F.col(f"x_{c}{k}") for c in ("size", "place", "label") for k in (0, 1)]
    m0, m1, j0, j1, b0, b1 = [F.col(f"y_{c}{k}") for c in ("size", "place", "label") for k in (0, 1)]
    order = F.struct("x_step", "x_salt") <= F.struct("y_step", "y_salt")
    most = F.least(i1, j1) + F.least(n1 - i0, m1 - j0)
    may = (4 * n1 >= 3 * m0) & (4 * m1 >= 3 * n0) & (most >= F.ceil((n0 + m0) * 3 / 7)) & ~((a0 == a1) & (b0 == b1) & (a0 == b0))
    same = (F.col("x_step") == F.col("y_step")) & (F.col("x_salt") == F.col("y_salt"))
    pairs = x.join(y, "list").filter(order & may).select(F.col("x_entries").alias("x"), F.col("y_entries").alias("y"), same.alias("same"))
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return map_arrow(pairs.repartition(parts, F.rand(7)), _units, _PARTIAL)


_PARTIAL = "node long, size long, other binary, other_size binary, shared binary, early binary"


def _whole_keys(batches: Iterator[pa.RecordBatch], columns_of, held: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows with one value in the first column stay together."""
    for batch in batches:
        columns = columns_of(batch)
        if not len(columns[0]):
            continue
        held = [np.concatenate(c) for c in zip(held, columns, strict=True)] if held else columns
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last value may go on in the next batch
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held:
        yield held


def _enough(closest: int | None):
    """Pairs of probing sets, which come sorted, that may still link: behind the prefix of one of the two
    sets all may be shared, before it only what the lists have shown. With ``closest``, of each
    probing set only so many, those with the most shared lists."""

    def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
        cells = {c: batch.column(c).to_pylist() for c in ("other", "other_size", "shared", "early")}
        many = np.array([len(c) // 8 for c in cells["other"]], np.int64)
        joined = lambda name, kind: np.frombuffer(b"".join(cells[name]), kind).astype(np.int64)
        return [np.repeat(np.array(batch.column("node")), many), np.repeat(np.array(batch.column("size")), many), joined("other", np.int64), *[joined(c, np.int32) for c in ("other_size", "shared", "early")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256))
        for columns in _whole_keys(slices, unpacked, []):
            order = np.lexsort((columns[2], columns[0]))
            node, n, other, m, shared, early = [c[order] for c in columns]
            edge = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])))
            shared, early = np.add.reduceat(shared, edge), np.add.reduceat(early, edge)
            node, n, other, m = node[edge], n[edge], other[edge], m[edge]
            keep = (early > 0) & (shared + np.maximum(n - prefix(n), m - prefix(m)) >= overlap_needed(n, m))
            node, other, shared = node[keep], other[keep], shared[keep]
            if closest is not None:
                order = np.lexsort((other, -shared, node))
                node, other = node[order], other[order]
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
                near = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node)))) < closest
                node, other = node[near], other[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, other)), pa.array(np.maximum(node, other))], names=["a", "b"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets, 64 bits a shingle."""
    for batch in batches:
        for _, _, sets in _chunks(batch):
            first = sets.first.tolist()
            cells = [sets.hash[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sets.node), pa.array(cells, pa.binary())], names=["node", "shingles"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much the sets of each pair have in common, with their sizes."""
    for batch in (part for whole in batches for at in range(0, len(whole), 256) for part in [whole.slice(at, 256)]):
        found, memory = [], (None, None)
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            if memory[0] != y:
                memory = (y, np.frombuffer(y, np.uint64))
            x, y = np.frombuffer(x, np.uint64), memory[1]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            found.append((int((y[at] == x).sum()), len(x), len(y)))
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "common", "na", "nb"])


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """Sets of the ends of ``pairs`` (a, b), made again from the one text that stands for each node
    (``nodes``: node, doc_id, mark)."""
    wanted = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), f"{tag}-wanted")
    small = wanted.count() <= BROADCAST_NODES
    texts = docs.join(F.broadcast(wanted) if small else wanted, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.mark == F.col("_mark")), "left_semi")
    return stage(map_arrow(texts.select("text"), _pack, "node long, shingles binary").dropDuplicates(["node"]), f"{tag}-sets")


def _compared(sets: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """``pairs`` (a, b) with common, na and nb."""
    both = pairs.select("a", "b").join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    return stage(map_arrow(both.select("a", "b", "left", "right"), _common, "a long, b long, common long, na long, nb long"), f"{tag}-common")


def _linking(compared: DataFrame) -> DataFrame:
    return compared.filter("100 * common >= 75 * (na + nb - common)")


def _leaders(links: DataFrame) -> DataFrame:
    """Of each end of ``links`` (a, b, common, na, nb): its leader, how many of its shingles the leader
    lacks (``over``) and how many of the leader's it lacks (``under``). The leader is the partner
    with the most links, so few sets lead many, then the closest one."""
    side = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("leader"), (F.col(f"n{x}") - F.col("common")).alias("over"), (F.col(f"n{y}") - F.col("common")).alias("under"))
    ends = links.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).select("e.*")
    degree = ends.groupBy(F.col("node").alias("leader")).agg(F.count("*").alias("many"))
    ranked = ends.join(degree, "leader").join(degree.toDF("node", "own"), "node").filter("many > own or (many = own and leader < node)")
    best = F.max_by(F.struct("leader", "over", "under"), F.struct("many", -F.col("over") - F.col("under"), -F.col("leader"))).alias("r")
    return ranked.groupBy("node").agg(best).select("node", "r.leader", "r.over", "r.under")


def _answered(sets: DataFrame, pairs: DataFrame, sizes: DataFrame, leaders: DataFrame, tag: str) -> DataFrame:
    """Which of ``pairs`` (a, b) link. Sets are answered from their leaders' answers where those decide,
    and only the rest is compared. ``sizes`` (node, n); a set without a leader leads itself."""
    led = sizes.join(leaders, "node", "left").select("node", "n", F.coalesce("leader", "node").alias("leader"), F.coalesce("over", F.lit(0).cast("long")).alias("over"), F.coalesce("under", F.lit(0).cast("long")).alias("under"))
    side = lambda x: led.toDF(x, f"n{x}", f"l{x}", f"over_{x}", f"under_{x}")
    known = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"x": F.least("la", "lb"), "y": F.greatest("la", "lb")})
    known = stage(known, f"{tag}-led")
    asked = known.groupBy("x", "y").agg(F.count("*").alias("many"), F.max((F.col("la") == F.col("a")) & (F.col("lb") == F.col("b"))).alias("own"))
    asked = asked.filter("x <> y and (many > 1 or own)").select(F.col("x").alias("a"), F.col("y").alias("b"))
    answers = _compared(sets, asked, f"{tag}-leaders").select(F.col("a").alias("x"), F.col("b").alias("y"), "common")
    need = F.ceil((F.col("na") + F.col("nb")) * 3 / 7)
    derived = known.join(answers, ["x", "y"], "left").select(
        "a", "b", (F.col("common") - F.col("under_a") - F.col("under_b") >= need).alias("sure"), (F.col("common") + F.col("over_a") + F.col("over_b") < need).alias("never"),
    )
    derived = stage(derived.filter("never is null or not never"), f"{tag}-derived")
    return derived.filter("sure").select("a", "b").unionByName(_linking(_compared(sets, derived.filter("sure is null or not sure"), f"{tag}-rest")).select("a", "b"))


def _open(lists: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The lists that hold several components, with each entry's ``label``, its component's size and how
    many links it has."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("weight"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = lists.select("list", "node", "size", "place").join(labels.join(sizes, "label").join(degree, "node", "left"), "node", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    known = known.withColumns({"label": F.coalesce("label", "node"), "weight": F.coalesce("weight", one), "degree": F.coalesce("degree", none)})
    mixed = known.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("length")).filter("x < y").select("list", "length")
    return known.join(mixed, "list").select("list", "node", "size", "place", "label", "weight", "degree", "length").sortWithinPartitions("list")


def _candidates(lists: DataFrame, nodes: DataFrame, closest: int | None) -> DataFrame:
    """Pairs (a, b) that share lists but no component yet, and enough of their prefixes and sketches."""
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    known = lists.join(nodes.select("node", "sketch"), "node")
    short = known.filter(F.col("length") <= BLOCK).select("list", *_FIELDS, "sketch")
    rest = map_arrow(short.repartition(parts, "list").sortWithinPartitions("list"), _rest, _PARTIAL)
    if lists.filter(F.col("length") > BLOCK).limit(1).count():  # where there are none, this would be an empty plan
        rest = rest.unionByName(_long_lists(known.filter(F.col("length") > BLOCK)))
    return map_arrow(rest.repartition(parts, "node").sortWithinPartitions("node"), _enough(closest), "a long, b long").distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    with scope(remove=False) as staged:
        return _linked(docs, staged)


def _linked(docs: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, mark): each row as doc_id, mark, n and node; and each node as node,
    the doc_id and mark of the row that stands for it, and the label of its component."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = stage(map_arrow(docs, _sizes, f"doc_id {kind}, mark long, n long, node long, sketch binary"), "near-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    nodes = sizes.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.select("node", "r.doc_id", "r.mark", "n", "sketch"), "near-nodes")
    groups = lambda entries: max(LEAST_GROUPS, entries // GROUP_ENTRIES)

    bits = int(groups(total) - 1).bit_length()
    counts = map_arrow(docs, _counts(bits), "group long, low binary, count binary")
    frequent = stage(counts.groupBy("group").applyInPandas(_frequent(FREQUENT), "bucket long, n long"), "near-frequent")
    least = FREQUENT
    while frequent.filter(F.col("n") > least).count() > FREQUENT_MOST:
        least *= 2
    often = frequent.filter(F.col("n") > least).toPandas()
    last = context.broadcast(Frequent(often["bucket"].to_numpy(np.int64), often["n"].to_numpy(np.int64), bits))

    bits = int(groups(total // 4) - 1).bit_length()
    entries = map_arrow(docs, _entries(last, bits), "group long, low binary, place binary, size binary, node binary")
    lists = stage(entries.groupBy("group").applyInPandas(_lists, "list long, node long, size int, place int"), "near-lists")

    # Pivots: in each round, sets not yet in the largest component of some list are compared with the
    # pivots that they most often stand next to. Sets that link need no comparing with each other.
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    tried = docs.sparkSession.createDataFrame([], "a long, b long")
    links = docs.sparkSession.createDataFrame([], "a long, b long, common long, na long, nb long")
    kept = lambda df: [df] if df.inputFiles() else []
    lists = stage(_open(lists, labels, links), "near-open-0")
    for turn in range(ROUNDS):
        met = map_arrow(lists, _star(turn), "node long, pivot long, size long, n long").groupBy("node", "pivot").agg(F.first("size").alias("size"), F.sum("n").alias("n"))
        met = met.filter(F.col("n") * LIKELY >= F.col("size") / 4)  # others are left to the exact rest
        pairs = met.select("node", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "n").join(tried, ["a", "b"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "a", "b"))
        pairs = pairs.withColumn("_rank", rank).filter(F.col("_rank") <= PROPOSALS).select("a", "b")
        pairs = stage(pairs.distinct(), f"near-pivots-{turn}")
        tried = tried.unionByName(pairs)
        near = _linking(_compared(_sets(docs, nodes, pairs, f"near-{turn}"), pairs, f"near-{turn}"))
        links = links.unionByName(near)
        labels = stage(merge_components(labels, near.select("a", "b")), f"near-labels-{turn}")
        lists = stage(_open(lists, labels, links), f"near-open-{turn + 1}")
        staged.drop(keep=[sizes, nodes, lists, labels, *kept(tried), *kept(links)])

    # Sets are next compared with the few partners they share most lists with, which joins what is left
    # of a family; and last with all that share enough and aren't of their component by then.
    pairs = stage(_candidates(lists, nodes, CLOSEST).join(tried, ["a", "b"], "left_anti"), "near-closest")
    tried = tried.unionByName(pairs)
    near = _linking(_compared(_sets(docs, nodes, pairs, "near-closest"), pairs, "near-closest"))
    links = links.unionByName(near)
    labels = stage(merge_components(labels, near.select("a", "b")), "near-labels-closest")
    lists = stage(_open(lists, labels, links), "near-open-rest")
    pairs = stage(_candidates(lists, nodes, None).join(tried, ["a", "b"], "left_anti"), "near-rest")
    leaders = stage(_leaders(links), "near-leaders")
    led = leaders.select("node", "leader")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(led, "node", "left")
    sets = _sets(docs, nodes, ends.select(F.col("node").alias("a"), F.coalesce("leader", "node").alias("b")), "near-last")
    found = _answered(sets, pairs, nodes.select("node", "n"), leaders, "near-last")
    labels = stage(merge_components(labels, found), "near-labels")
    staged.drop(keep=[sizes, nodes, labels])

    return sizes, nodes.join(labels, "node", "left").select("node", "doc_id", "mark", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as doc_id, n_shingles and component_id.

    Words are between white space, A-Z lower-cased. A set holds the distinct shingles of 5 words, or
    the whole sequence of fewer; two rows link if 100 * intersection >= 75 * union, and
    component_id is the least doc_id that links lead to. Rows without words (null and empty texts)
    have an empty set and link with nothing. Rows with null ids link like others but name no
    component, unless there is no other id; repeated rows get equal results. Empty tables give no
    rows; other columns are ignored. All sets are compared by 64-bit hashes of shingles, and a set is known by a 64-bit hash of its own.
    """
    sizes, named = _components(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stage(named.select("node", "label").join(least_id, "label").select("node", "component_id"), "near-named")
    found = sizes.select("doc_id", "n", "node").join(named, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less those that link with one that stays: of each component one
    row, that of the least doc_id (null ids last) and then of the least hash of its text.

    Rows without words link with nothing, so all of them stay. Of rows with one id and one text,
    any may be the one."""
    rows = as_row(docs).withColumns({"_id": F.col("_row.doc_id"), "_mark": F.xxhash64("_row.text")})
    sizes, named = _components(rows.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_mark").alias("mark")))
    stands = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    copies = sizes.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    same = copies.doc_id.eqNullSafe(stands.doc_id) & (copies.mark == stands.mark)
    kept = copies.join(stands.withColumn("stands", F.lit(True)), same, "left").filter("stands or n = 0")
    kept = stage(kept.select(copies.doc_id.alias("_kept_id"), copies.mark.alias("_kept_mark"), F.expr("n > 0 and copies > 1").alias("many")), "near-kept")

    def those(which: DataFrame) -> DataFrame:
        return rows.join(which, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi")

    found = those(kept.filter("not many")).select("_row")
    if kept.filter("many").limit(1).count():  # only these are shuffled, one row a task after combining
        found = found.unionByName(those(kept.filter("many")).groupBy("_id", "_mark").agg(F.first("_row").alias("_row")).select("_row"))
    return from_row(found, docs.columns)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
