"""The pipeline's rows against a plain Python version of all stages behind the trained classifier."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from tests.llm.test_operators import ALNUM_WORD, LOWER, SPACE_WORD, brute_lines, shingles

SF = "/root/testdata/sf0.001"


def linked(texts: dict[int, str]) -> set[int]:
    """Ids that stay: the least of each component of similar shingle sets."""
    sets = {d: shingles(t) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    holders = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            holders[g].add(d)
    for a, b in {(a, b) for group in holders.values() for a in group for b in group if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d for d in texts if root(d) == d}


def leaks(texts: dict[int, str], items: list[str]) -> set[int]:
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOWER))
    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    return {d for d, t in texts.items() if any(tuple(words(t)[i : i + n]) in windows for n in sizes for i in range(len(words(t)) - n + 1))}


def test_stages_against_plain_python(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from collatrix.llm.common import stage
    from collatrix.llm.op6_mix import BLOCK_TOKENS

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, function in pipeline.STAGES:
        docs = stage(function(spark, docs, SF), f"plain-{name}")
        found[name] = {r.doc_id: r for r in docs.collect()}

    before = found["quality"]
    ids = sorted(before)
    gone = brute_lines([before[d].text for d in ids])
    texts = {}
    for k, d in enumerate(ids):
        lost = {i for x, i in gone if x == k}
        text = "\n".join(t for i, t in enumerate(before[d].text.split("\n")) if i not in lost)
        if not lost or re.search(r"[^\x20\x09-\x0D]", text):
            texts[d] = text
    assert {d: r.text for d, r in found["lines"].items()} == texts
    assert all(r.n_chars == len(r.text) for r in found["lines"].values())

    kept = linked(texts)
    assert set(found["near_duplicates"]) == kept
    clean = kept - leaks({d: texts[d] for d in kept}, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert set(found["benchmark_leaks"]) == clean
    assert {d: r.text for d, r in found["benchmark_leaks"].items()} == {d: texts[d] for d in clean}

    mixed = found["mix"]
    assert set(mixed) == clean
    by_source = defaultdict(list)
    for d, r in mixed.items():
        assert r["size"] == len(SPACE_WORD.findall(texts[d])) and 0 <= r.taken <= 3 * r["size"]
        assert (r.text, r.lang, r.n_chars) == (texts[d], before[d].lang, len(texts[d]))
        by_source[before[d].source].append(r)
    for rows in by_source.values():
        assert rows[0].source_size == sum(r["size"] for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * BLOCK_TOKENS + 3 * BLOCK_TOKENS


AWKWARD = ("_row", "_removed", "_cut", "_kept", "_n", "_lines", "_number", "_leaks_number", "stats", "score", "size", "taken", "_draw", "_src", "_shard", "node", "label", "mark", "n", "stands", "many", "copies")


def test_stages_on_awkward_rows(spark):
    """Nulls, repeated rows and ids, empty tables, and columns with the names that the operators use."""
    from pyspark.sql import functions as F

    pipeline = pytest.importorskip("corpus_pipeline")
    first = spark.read.parquet(f"{SF}/documents.parquet").limit(4).collect()
    rows = [tuple(r) for r in first] * 2 + [(None, None, None, None, None), (None, "", "en", "a", 0), (first[0].doc_id, "of its own " * 9, "en", None, 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for c in AWKWARD:
        docs = docs.withColumn(c, F.lit(c))
    for name, function in pipeline.STAGES:
        found = function(spark, docs, SF)
        got = found.collect()
        if name == "mix":
            assert len(got) == len(rows) and set(docs.columns) <= set(found.columns) and len(found.columns) == len(set(found.columns))
        else:
            assert found.columns == docs.columns and len(got) <= len(rows)
            assert all(r[c] == c for r in got for c in AWKWARD)
        assert function(spark, docs.limit(0), SF).count() == 0
        if name == "near_duplicates":
            assert sum(r.doc_id is None for r in got) == 2 and len(got) <= 7
        if name == "lines":
            assert len(got) <= len(rows) - 4


def plain_discriminant(x, y, towards, weights):
    """Class densities by their definition, with inverses and determinants."""
    import numpy as np

    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - centre) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    a, b, g = weights
    cov = [a * own[c] + b * pooled + g * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1]) for c in (0, 1)]

    def score(v):
        v = (v - centre) / scale
        log = [np.log(((y == c).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * (v - z[y == c].mean(0)) @ np.linalg.inv(cov[c]) @ (v - z[y == c].mean(0)) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))

    return score


def test_quality_against_plain_numpy(spark):
    import binascii

    import numpy as np

    from collatrix.llm import op7_quality as o
    from collatrix.llm import tokens as tk

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if binascii.crc32(str(r.doc_id).encode()) % 5]
    import pyarrow as pa

    ids = list(texts)
    raw = {d: o.statistics(*tk.utf8(pa.array([texts[d]], pa.large_string())))[0] for d in ids}
    train = np.array([raw[d] for d, _ in known])
    towards, y = train.mean(0), np.array([q for _, q in known])
    score = plain_discriminant(o.damp(train, towards), y, towards, o.SHRINKAGE)
    got = {r.doc_id: r.score for r in o.quality_scores(docs, labels).collect()}
    assert got.keys() == raw.keys()
    assert all(abs(got[d] - score(o.damp(raw[d][None], towards)[0])) < 1e-6 for d in ids)
    words = texts[ids[0]].split()  # two of the statistics by their definition
    assert abs(raw[ids[0]][0] - np.log1p(len(words))) < 1e-12
    part, whole = sum(w[0].isascii() and w[0].isupper() for w in words), len(words)
    assert abs(raw[ids[0]][-1] - np.log((part + 0.5) / (whole - part + 0.5) * (1 + 2 / (whole + 1)))) < 1e-12
