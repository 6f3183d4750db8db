"""URL filter: host and path rules first, link-graph propagation for the rest.

Hosts are the nodes and links between pages of different hosts the edges. Trust is a personalised
PageRank from hosts with allowed pages along the links; distrust is one from hosts with blocked
pages against them, as who links to a bad host is suspect. A path rule so weighs on its host by
the share of the host's pages that it fits. A host whose share of distrust reaches the threshold
is blocked, for pages that no rule fits.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.common import UPPER, map_arrow, ship, stage, table
from collatrix.llm.op2_extract import tags

#: (verdict, host, path): a rule fits its host and subdomains if the url's path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 20
#: Rounds between cuts of the lineage.
STAGE_EVERY = 5
#: Share of distrust in a host's weight. A host of one plain page whose only link goes to a blocked host
#: that nobody else links to has 0.46.
THRESHOLD = 0.3
MOST_RULES = 500
_HREF = re.compile(r"""(?:^|\s|["'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_NAMES_HOST = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Of rules of one length the one with the
    longer host wins, then block. A parameter of at most ``MOST_RULES`` rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
    struct = lambda v, h, p: F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    return F.coalesce(*[F.when(fits(h, p), struct(v, h, p)) for v, h, p in order], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, link, n) of the links of each page that name a host, from its anchors and areas; ``base``
    elements count. Scripts and comments have no anchors, and character references are decoded."""
    for batch in batches:
        urls, found, many = [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            counts, base = Counter(), ""
            for _, _, name, closes, attributes in tags(page):
                if closes or name not in ("a", "area", "base") or not (m := _HREF.search(attributes)):
                    continue
                href = re.sub(r"[\t\n\r]", "", html.unescape(m[1] or m[2] or m[3] or "")).strip(" \x0c")
                if name == "base":
                    base = base or href
                elif "//" in href.split("?")[0].split("#")[0] and _NAMES_HOST.match(href):
                    counts[href[href.index("//") :]] += 1
                elif base and not _SCHEME.match(href) and not href.startswith("#"):
                    counts[base[base.index("//") :] if "//" in base else ""] += 1
            for link, n in counts.items():
                if link:
                    urls.append(url)
                    found.append("x:" + link)
                    many.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array(many, pa.int64())], names=["url", "link", "n"])


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, by number. Links without a host are to the page's own
    host or that of its ``base`` element. Pages without ``//`` or a character reference have none."""
    ship(pages.sparkSession)
    may = pages.filter(F.col("url").contains("://") & (F.col("html").contains("//") | F.col("html").contains("&"))).select("url", "html")
    links = map_arrow(may, _links, "url string, link string, n long").select(host_of(F.col("url")).alias("src"), host_of(F.col("link")).alias("dst"), "n")
    return links.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of several kinds at once.

    ``edges`` (kind, src, dst, n), ``seeds`` (kind, host, score) with scores of a kind summing to 1.
    Score of hosts without edges out is not passed on. Each round is one join on (kind, host) and
    one sum by target, which combines before the shuffle; a hub's rows are split by the adaptive
    skew join.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("_all"))
    steps = stage(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("_all")).alias("share")), "url-edges")
    base = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores = base
    if not steps.limit(1).count():
        return scores
    for i in range(1, rounds + 1):
        passed = scores.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        scores = base.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % STAGE_EVERY == 0 or i == rounds:
            scores = stage(scores, "url-scores")
    return scores


def host_verdicts(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, plain, share, by_links) of the hosts that have any score.

    Seeds weigh by pages, all kinds on one scale: allowed pages trust, blocked pages distrust, and
    pages that no rule fits are plain. Trust and plain weight flow along links, distrust against
    them. A host's share of distrust is that of all its weight, so neither one blocked page among
    many nor one link to a blocked host makes a large host suspect.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter(F.col("host") != "")
    verdict = fitting_rule(F.col("host"), F.col("path"), rules)["verdict"]
    kind = F.when(verdict == "allow", "trust").when(verdict == "block", "distrust").otherwise("plain")
    counts = stage(seen.groupBy("host", kind.alias("kind")).agg(F.count("*").alias("n")), "url-seeds")
    total = counts.agg(F.sum("n").alias("all"))  # one row
    seeds = stage(counts.crossJoin(F.broadcast(total)).select("kind", "host", (F.col("n") / F.col("all")).alias("score")), "url-seed-scores")
    edges = stage(host_edges(pages), "url-links")
    along = lambda kind, src, dst: F.struct(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
    both = edges.select(F.explode(F.array(along("trust", "src", "dst"), along("plain", "src", "dst"), along("distrust", "dst", "src"))).alias("e")).select("e.*")
    scores = propagate(both, seeds, damping, rounds)
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    found = scores.groupBy("host").agg(one("trust"), one("distrust"), one("plain"))
    found = found.withColumn("share", F.round(F.col("distrust") / (F.col("trust") + F.col("distrust") + F.col("plain")), 9))
    return found.withColumn("by_links", F.when(F.col("share") >= threshold, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Each page with host, path, rule and verdict (allow or block).

    The verdict is the fitting rule's, else that of the host's propagated scores; hosts without
    any score are allowed. Null urls and urls without ``://`` have empty host and path, fit no rule
    and are allowed. Null html has no links. Repeated rows give repeated results; an empty table
    gives no rows. Columns out: page_id, host, path, rule, verdict; other columns are ignored.
    """
    hosts = stage(host_verdicts(pages, rules, damping, rounds, threshold).select("host", "by_links"), "url-hosts")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", "by_links", F.lit("allow")).alias("verdict"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
