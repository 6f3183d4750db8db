"""Secret scan through a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold. An index
(trigram, document) of the texts answers the queries by intersecting postings; only candidates are
run through the regex. Rules whose regex forces no trigram scan every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.common import stage, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``kind`` of span, its regex (Java and Python read it alike), and, where a group of a match
    must have some length, that group and the least length; other matches are dropped but still
    use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds whose spans make the base digest, in the order of their listing.
BASE_RULES = (
    Rule("assign", r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Matches of a text whose places are summed together.
BLOCK = 128
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"

#: A query is a conjunction of clauses, a clause a disjunction of trigram sets.
Query = frozenset[frozenset[frozenset[str]]]
_MOST_STRINGS = 64


def _clauses(strings: frozenset[str] | None) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return frozenset()
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset([frozenset(a for a in sets if not any(b < a for b in sets))])


def _exact(node) -> frozenset[str] | None:
    """All strings (lower-cased) that one parsed element matches, if they are few."""
    kind, value = node
    if kind is rc.LITERAL:
        return frozenset([chr(value).lower()])
    if kind is rc.IN:
        found: set[str] = set()
        for what, v in value:
            if what is rc.LITERAL:
                found.add(chr(v).lower())
            elif what is rc.RANGE and v[1] - v[0] < _MOST_STRINGS:
                found.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return frozenset(found) if len(found) <= 8 else None
    if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, body = value
        if high is rc.MAXREPEAT or high > 4:
            return None
        one = _exact_sequence(body)
        if one is None:
            return None
        found, power = set(), frozenset([""])
        for n in range(high + 1):
            if n >= low:
                found |= power
            power = frozenset(a + b for a in power for b in one)
            if len(power) > _MOST_STRINGS:
                return None
        return frozenset(found) if len(found) <= _MOST_STRINGS else None
    if kind is rc.SUBPATTERN:
        return _exact_sequence(value[3])
    if kind is rc.BRANCH:
        branches = [_exact_sequence(b) for b in value[1]]
        if any(b is None for b in branches):
            return None
        return frozenset().union(*branches)
    return None


def _exact_sequence(nodes) -> frozenset[str] | None:
    found = frozenset([""])
    for node in nodes:
        more = _exact(node)
        if more is None or len(found) * len(more) > _MOST_STRINGS:
            return None
        found = frozenset(a + b for a in found for b in more)
    return found


def _sequence_query(nodes) -> Query:
    """Runs of elements with few strings give clauses; other elements end a run."""
    out: Query = frozenset()
    run: frozenset[str] = frozenset([""])
    for node in nodes:
        more = _exact(node)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = frozenset(a + b for a in run for b in more)
            continue
        out |= _clauses(run)
        run = more if more is not None else frozenset([""])
        kind, value = node
        if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT) and more is None:
            out |= _sequence_query(value[2]) if value[0] else frozenset()
        elif kind is rc.SUBPATTERN and more is None:
            out |= _sequence_query(value[3])
    return out | _clauses(run)


def trigram_query(pattern: str) -> Query:
    """Trigrams, lower-cased, that every text with a match of ``pattern`` holds; empty if none are
    certain. Case-insensitive flags need no care, as texts are lower-cased for the index."""
    return _sequence_query(rp.parse(pattern.replace("(?i)", "")))


def _key() -> Column:
    return F.struct(F.xxhash64("doc_id", "_text").alias("a"), F.hash("_text", "doc_id").alias("b"))


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (tri, key) for the vocabulary that the rules can ask for, kept in the shared folder.
    One posting a text and trigram that it holds, so postings are linear in the input."""
    low = texts.select(_key().alias("key"), F.lower("_text").alias("low"))
    vocabulary = F.array(*[F.lit(t) for t in trigrams])
    return stage(low.select("key", F.explode(F.filter(vocabulary, lambda t: F.contains(F.col("low"), t))).alias("tri")), "secret-index")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect the postings: (key, kinds) of the texts that fulfil a kind's query."""
    held = index.groupBy("key").agg(F.collect_set("tri").alias("held"))  # at most the vocabulary

    def fulfils(query: Query) -> Column:
        def any_of(clause):
            return reduce(Column.__or__, [F.size(F.array_intersect("held", F.array(*[F.lit(t) for t in sorted(alt)]))) == len(alt) for alt in sorted(clause, key=sorted)])

        return reduce(Column.__and__, [any_of(clause) for clause in query])

    kinds = F.filter(F.array(*[F.when(fulfils(q), F.lit(kind)) for kind, q in sorted(queries.items())]), lambda k: k.isNotNull())
    return held.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches in ``_text`` as array of (start, rank, kind, end) in code points.

    The lengths of matches and of the parts between them give the positions by a running sum, first
    over blocks of ``BLOCK`` matches and then inside each, so that the arrays that grow stay short.
    """
    parts = F.split("_text", rule.pattern, -1)
    whole = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(parts.alias("p"), whole.alias("m"), tested.alias("g")) if rule.group else F.arrays_zip(parts.alias("p"), whole.alias("m"))
    length = lambda x: F.coalesce(F.char_length(x), F.lit(0))
    empty = F.array().cast(_SPANS)

    def block(r: Column, k: Column) -> Column:
        return F.slice(r, k * BLOCK + 1, F.lit(BLOCK))

    def starts(sizes: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + length(row["p"])
        end = start + length(row["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        keep = row["m"].isNotNull() & (F.char_length(row["g" if rule.group else "m"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def found(r: Column) -> Column:
        many = F.sequence(F.lit(0), (F.ceil(F.size(r) / BLOCK) - 1).cast("int"))
        sizes = F.transform(many, lambda k: F.aggregate(block(r, k), F.lit(0), lambda n, row: n + length(row["p"]) + length(row["m"])))
        inside = lambda at, k: F.aggregate(block(r, k), F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(starts(sizes), inside))

    return _let(rows, found)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each document with ``spans``: all matches of all rules, by start, then order of the rules.

    Columns out: doc_id, spans array<struct<start,rank,kind,end>>. Null text counts as empty; no
    match gives an empty array. One row out for each row in; rows alike in id and text get like
    results. Offsets are code points, end exclusive. Other columns are ignored; an empty table
    gives no rows. Whole texts are scanned.
    """
    texts = docs.select("doc_id", text_or_empty("text").alias("_text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    vocabulary = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    none = F.array().cast(_SPANS)
    if vocabulary:
        found = candidates(build_index(texts, vocabulary), queries)
        texts = texts.withColumn("key", _key()).join(found, "key", "left").drop("key")
    else:
        texts = texts.withColumn("kinds", F.lit(None).cast("array<string>"))
    each = []
    for rank, rule in enumerate(rules):
        own = spans(rule, rank)
        each.append(F.when(F.array_contains("kinds", rule.kind), own).otherwise(none) if rule.kind in queries else own)
    return texts.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = found.withColumn("_base", F.filter("spans", lambda s: s["rank"] < len(BASE_RULES)))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined("_base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
