"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Source targets come from weights and caps; equal-token blocks are then dealt by highest quotients
``target / (2k + 1)``, first to sources and then to each source's shards, so quotas are integers
and sum exactly. In a shard the documents, in an order drawn from the seed, form a ring of blocks;
the quota takes them from its start, whole rounds first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.llm.common import as_row, stage, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of one block. Small blocks keep small sources near their targets; their number costs nothing.
BLOCK_TOKENS = 16
DOCS_PER_SHARD = 512
#: Shards that are apportioned together: a source deals to its groups of shards and these to their shards.
GROUP_SHARDS = 1024
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def apportion(items: DataFrame, group: list[str], weight: Column, total: Column, count: Column, seats: Column, order: list[str]) -> DataFrame:
    """Add the long column ``quota``: the Sainte-Lague seats of each item in its group.

    ``total`` and ``count`` are the group's sum of weights and number of items. With c items, the
    seats for the divisor total/(seats - c/2) sum to at most ``seats`` and those for
    total/(seats + c/2) to at least that, so only quotients between the two are ranked: about two
    an item, however many seats there are. Equal quotients go to the first in ``order``.
    """
    share = lambda n: F.when(total > 0, F.floor(weight * n / total + 0.5)).otherwise(F.lit(0)).cast("long")
    base = items.withColumns({
        "_seats": seats,
        "_weight": weight.cast("double"),
        "_low": F.greatest(F.lit(0).cast("long"), share(F.greatest(F.lit(0.0), seats - count / 2)) - 1),
        "_high": share(seats + count / 2) + 1,
    })
    low = base.groupBy(*group).agg(F.sum("_low").alias("_sum_low")) if group else base.agg(F.sum("_low").alias("_sum_low"))
    base = base.join(low, group) if group else base.withColumn("_sum_low", F.sum("_low").over(Window.partitionBy(F.lit(0))))
    ranked = base.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_q", F.col("_weight") / (2 * F.col("_k") + 1))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_q"), *order)))
    won = F.sum(((F.col("_rank") <= F.col("_seats") - F.col("_sum_low")) & (F.col("_q") > 0)).cast("long"))
    keys = list(dict.fromkeys([*group, *order]))
    kept = [c for c in items.columns if c not in keys]
    return ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], (F.first("_low") + won).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of one row a source (``_src``, ``source``, ``source_size``): add ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target stops at ``cap``
    times the source's size and the excess is shared again by weight. The end of that is one level
    L with target = min(cap * size, L * weight): sources sorted by cap * size / weight are capped
    as long as that ratio is at most the level of what is left.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_order", F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source"))))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(turn, (F.col("_order") - 1) % len(weights) + 1)).withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = one.orderBy(F.col("_most") / F.col("_w"), "_order")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "_level": (F.sum("source_size").over(one) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
        "_at": F.row_number().over(by_ratio),
    })
    free = F.col("_most") / F.col("_w") > F.col("_level")
    ranked = ranked.withColumn("_first", F.min(F.when(free, F.struct("_at", "_level"))).over(one))
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), F.col("_most")).otherwise(F.col("_first._level") * F.col("_w"))
    return ranked.withColumn("target", target).drop("_w", "_most", "_level", "_at", "_first")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_tokens: int = BLOCK_TOKENS, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED, carry: bool = False) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken. With
    ``carry``, all columns of ``docs`` come first, less those whose names are among the four new ones.

    Sizes are words of the whole text (null or empty: 0, taken 0). One row out for each row in,
    repeated rows included; rows that are equal in id and size are interchangeable. Null ids and
    sources are ordinary values; other columns are ignored. An empty table gives no rows. The
    same seed gives the same result whatever the partitioning.

    A shard holds about ``docs_per_shard`` documents of all sources together, and ``GROUP_SHARDS``
    shards make a group. Blocks go to sources, from these to their groups and from those to their
    shards, so a task sees a source's groups or a group's shards (or all sources, one row each), never
    a source's documents or shards. Quotas never exceed ``cap`` times a shard's words.
    """
    rows = as_row(docs)
    words = F.coalesce(F.regexp_count("_row.text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage(rows.select(
        *(["_row"] if carry else []), "_row.doc_id", "_row.source", words.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null")))).alias("_draw"),
    ), "mix-sizes")
    sized = sized.withColumn("_src", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    shards = max(1, -(-sized.count() // docs_per_shard))
    sized = sized.withColumn("_shard", F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") % shards)

    per_shard = stage(sized.groupBy("_src", "source", "_shard").agg(F.sum("size").alias("_shard_size")), "mix-shards")
    sources = source_targets(per_shard.groupBy("_src", "source").agg(F.sum("_shard_size").alias("source_size")), weights, cap)
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumns({"_total": F.sum("target").over(one), "_n": F.count("*").over(one).cast("double"), "_blocks": F.round(F.sum("source_size").over(one) / block_tokens).cast("long")})
    dealt = stage(apportion(sources, [], F.col("target"), F.col("_total"), F.col("_n"), F.col("_blocks"), ["_order"]).withColumnRenamed("quota", "_source_quota"), "mix-sources")

    grouped = per_shard.drop("source").withColumn("_group", F.floor(F.col("_shard") / GROUP_SHARDS))
    groups = grouped.groupBy("_src", "_group").agg(F.sum("_shard_size").alias("_group_size"), F.count("*").alias("_members"))
    per_source = groups.groupBy("_src").agg(F.count("*").alias("_groups"))
    to_groups = groups.join(per_source, "_src").join(dealt.select("_src", "source_size", "target", "_source_quota"), "_src")
    group_quotas = apportion(to_groups, ["_src"], F.col("_group_size"), F.col("source_size"), F.col("_groups").cast("double"), F.col("_source_quota"), ["_group"])
    group_quotas = stage(group_quotas.withColumnRenamed("quota", "_group_quota"), "mix-groups")
    to_shards = grouped.join(group_quotas.select("_src", "_group", "source_size", "target", "_group_size", "_members", "_group_quota"), ["_src", "_group"])
    quotas = apportion(to_shards, ["_src", "_group"], F.col("_shard_size"), F.col("_group_size"), F.col("_members").cast("double"), F.col("_group_quota"), ["_shard"])
    most = F.least(F.col("quota") * block_tokens, F.col("_shard_size") * cap)
    quotas = quotas.select("_src", "_shard", "_shard_size", "source_size", "target", most.alias("_quota"))

    ring = Window.partitionBy("_src", "_shard").orderBy("_draw", F.col("doc_id"), F.col("size"))
    placed = sized.join(quotas, ["_src", "_shard"]).withColumn("_at", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rounds = F.when(F.col("_shard_size") > 0, F.expr("_quota div _shard_size")).otherwise(F.lit(0))
    rest = F.col("_quota") - rounds * F.col("_shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    more = [F.col("size"), F.col("source_size"), F.col("target"), taken.cast("long").alias("taken")]
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")] if carry else [F.col("doc_id")]
    return placed.select(*own, *more)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
