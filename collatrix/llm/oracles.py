"""DuckDB SQL of the queries that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

from collatrix.llm.op3_lines import MIN_NEAR_WORDS, MIN_WORDS
from collatrix.llm.op6_mix import BLOCK_TOKENS, CAP, DOCS_PER_SHARD, GROUP_SHARDS, SEED
from collatrix.llm.op8_secrets import BASE_RULES, RULES, Rule

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _seats(name: str, table: str, group: str, weight: str, total: str, count: str, seats: str, order: str) -> str:
    """CTEs of the apportionment, ending in ``name`` with the column quota."""
    share = lambda n: f"CAST(CASE WHEN {total} > 0 THEN floor({weight} * ({n}) / {total} + 0.5) ELSE 0 END AS BIGINT)"
    return f"""
{name}_base AS (SELECT *, greatest(0, {share(f'greatest(0.0, {seats} - {count} / 2)')} - 1) AS low, {share(f'{seats} + {count} / 2')} + 1 AS high FROM {table}),
{name}_low AS (SELECT *, sum(low) OVER (PARTITION BY {group}) AS sum_low FROM {name}_base),
{name}_q AS (SELECT *, CAST({weight} AS DOUBLE) / (2 * k + 1) AS q FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM {name}_low)),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {order}) AS place FROM {name}_q),
{name}_won AS (SELECT {group} AS g, {order} AS o, min(low) + count(*) FILTER (WHERE place <= {seats} - sum_low AND q > 0) AS quota FROM {name}_rank GROUP BY ALL),
{name} AS (SELECT t.*, w.quota FROM {table} t JOIN {name}_won w ON w.g = t.{group} AND w.o = t.{order})"""


OP6 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents
), sharded AS (
  SELECT *, CAST(('0x' || substr(draw, 1, 8)) AS BIGINT) % greatest(1, ((SELECT count(*) FROM sized) + {DOCS_PER_SHARD - 1}) // {DOCS_PER_SHARD}) AS shard FROM sized
), per_shard AS (SELECT src, source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM sharded GROUP BY ALL),
ordered AS (
  SELECT src, source, CAST(sum(shard_size) AS BIGINT) AS source_size, count(*) AS shards, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM per_shard GROUP BY src, source
), weighed AS (SELECT *, [5.0, 2.0, 1.0][(o - 1) % 3 + 1]::DOUBLE AS w, {CAP}.0::DOUBLE * source_size AS most FROM ordered),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level, row_number() OVER (ORDER BY most / w, o) AS spot FROM weighed
  WINDOW r AS (ORDER BY most / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (SELECT min(spot) AS first_at, arg_min(level, spot) AS first_level FROM levels WHERE most / w > level),
targets AS (
  SELECT src, source, source_size, shards, o, 1 AS one, CASE WHEN first_at IS NULL OR spot < first_at THEN most ELSE first_level * w END AS target FROM levels LEFT JOIN first ON true
), totals AS (
  SELECT *, sum(target) OVER () AS total, CAST(count(*) OVER () AS DOUBLE) AS n, CAST(round((sum(source_size) OVER ())::DOUBLE / {BLOCK_TOKENS}) AS BIGINT) AS blocks FROM targets
),{_seats('dealt', 'totals', 'one', 'target', 'total', 'n', 'blocks', 'o')},
to_groups AS (
  SELECT g.*, d.source_size, d.target, d.quota AS source_quota, CAST(count(*) OVER (PARTITION BY g.src) AS DOUBLE) AS group_count
  FROM (SELECT src, shard // {GROUP_SHARDS} AS grp, CAST(sum(shard_size) AS BIGINT) AS group_size, CAST(count(*) AS DOUBLE) AS members FROM per_shard GROUP BY ALL) g JOIN dealt d USING (src)
),{_seats('grouped', 'to_groups', 'src', 'group_size', 'source_size', 'group_count', 'source_quota', 'grp')},
to_shards AS (
  SELECT p.src, p.shard, p.shard_size, d.source_size, d.target, d.group_size, d.members, d.quota AS group_quota, p.src || ':' || d.grp AS sg FROM per_shard p JOIN grouped d ON d.src = p.src AND d.grp = p.shard // {GROUP_SHARDS}
),{_seats('quotas', 'to_shards', 'sg', 'shard_size', 'group_size', 'members', 'group_quota', 'shard')},
placed AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.shard_size, least(q.quota * {BLOCK_TOKENS}, q.shard_size * {CAP}) AS quota,
    sum(s.size) OVER (PARTITION BY s.src, s.shard ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before FROM sharded s JOIN quotas q ON q.src = s.src AND q.shard = s.shard
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN quota // shard_size * size + greatest(0, least(size, quota % shard_size - before)) ELSE 0 END AS BIGINT) AS taken FROM placed
"""


def _spans(rule: Rule, rank: int) -> str:
    """The rule's matches as a list of structs, from the text between them and their own lengths."""
    pattern = rule.pattern.replace("((?i)", "((?i:", 1).replace("key)", "key))", 1) if "(?i)" in rule.pattern else rule.pattern
    pattern = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(m{rank}) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(p{rank}[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m{rank}[1:i - 1], lambda x: length(x))), 0), 'rank': {rank}, 'kind': '{rule.kind}', 'size': length(m{rank}[i]), 'ok': length(g{rank}[i]) >= {rule.least}}}), lambda s: s.ok)""", (
        f"string_split_regex(text, '{pattern}') AS p{rank}, regexp_extract_all(text, '{pattern}', 0) AS m{rank}, regexp_extract_all(text, '{pattern}', {rule.group}) AS g{rank}"
    )


_PARTS = [_spans(r, i) for i, r in enumerate(RULES)]
_TEXT = "array_to_string(list_transform({}, lambda y: y.kind || ':' || CAST(y.start AS BIGINT) || ':' || CAST(y.start + y.size AS BIGINT)), ',')"
OP8 = f"""
WITH parts AS (SELECT doc_id, {', '.join(columns for _, columns in _PARTS)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
found AS (SELECT doc_id, list_sort({' || '.join(spans for spans, _ in _PARTS)}) AS s FROM parts)
SELECT doc_id, {', '.join(f"CAST(len(list_filter(s, lambda x: x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)},
  sha256({_TEXT.format(f'list_filter(s, lambda x: x.rank < {len(BASE_RULES)})')}) AS base_sha256, {_TEXT.format('s')} AS spans FROM found
"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w, row_number() OVER () AS row FROM documents),
runs AS (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT row, i, runs.k, item FROM runs JOIN windows ON windows.k = runs.k AND windows.run = runs.run),
places AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS place FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (row) LEFT JOIN named USING (row)
"""

_LINE = f"regexp_extract_all({_LOWER.format('line')}, '[^\\x20\\x09-\\x0D]+')"
OP3 = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, {_LINE} AS w FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM raw) WHERE len({_LINE}) >= {MIN_WORDS}),
d AS (SELECT w, min({{'d': doc_id, 'i': i}}) AS first FROM l GROUP BY w),
long AS (SELECT w, first, md5(array_to_string(w, ' ')) AS whole FROM d WHERE len(w) >= {MIN_NEAR_WORDS}),
v AS (SELECT first, j, md5(array_to_string(w[1:j - 1] || w[j + 1:len(w)], ' ')) AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM long)),
near AS (
  SELECT first FROM (SELECT first, min(first) OVER (PARTITION BY rest, j) AS earliest FROM v) WHERE earliest < first
  UNION SELECT greatest(v.first, long.first) AS first FROM v JOIN long ON v.rest = long.whole WHERE v.first <> long.first
),
gone AS (SELECT l.doc_id, l.i FROM l JOIN d USING (w) WHERE d.first <> {{'d': l.doc_id, 'i': l.i}} OR d.first IN (SELECT first FROM near)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, k: NOT list_contains(g, k)), chr(10)) END AS text, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM raw LEFT JOIN lists USING (doc_id)
"""

ORACLES = {"op3_lines": OP3, "op5_topk": OP5, "op6_mix": OP6, "op8_secrets": OP8, "op9_decontaminate": OP9}
