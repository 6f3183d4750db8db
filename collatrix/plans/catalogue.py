"""Queries of the driver over its tables, by the engine's operators, and their DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.functions.keys import orders, u64_text
from collatrix.operators import dedup, limit, merge, split
from collatrix.operators.convert import convert
from collatrix.operators.order import positioned, sort_with_positions, with_keys
from collatrix.operators.verify import violations
from collatrix.sources import sample
from collatrix.sources.scan import assemble_multiline
from collatrix.spec import SortSpec
from collatrix.staging import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def _records(df: DataFrame, value, rid) -> DataFrame:
    """A record table of one column, in the order of ``rid``."""
    where = F.struct(F.lit(0).alias("file"), F.lit(0).cast("long").alias("block"), rid.cast("long").alias("row"))
    return df.select(value.alias("value"), where.alias("_rid"))


def _csv(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    return _records(df, F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.col(rid))


def _part(i: int):
    return F.split_part("value", F.lit(","), F.lit(i + 1))


def _u64(df: DataFrame, column: str) -> DataFrame:
    """Numbers as 8 bytes, most significant first."""
    return _records(df, F.unhex(F.lpad(F.hex(F.col(column)), 16, "0")), F.col("o_orderkey"))


def sort_u64_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SortSpec(input="-", output="-")
    rows = sort_with_positions(_u64(table(spark, sf_dir, "orders"), "o_orderkey"), spec)
    return rows.select("pos", u64_text(F.col("value")).cast("long").alias("o_orderkey"))


def sort_u64_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SortSpec(input="-", output="-", reverse=True)
    rows = sort_with_positions(_u64(table(spark, sf_dir, "orders"), "o_custkey"), spec)
    return rows.select("pos", u64_text(F.col("value")).cast("long").alias("o_custkey"), F.col("_rid.row").alias("o_orderkey"))


def sort_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_custkey"))
    return sort_with_positions(rows, SortSpec(input="-", output="-", format="string")).select("pos", F.col("value").alias("c_name"))


def sort_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_partkey"))
    spec = SortSpec(input="-", output="-", format="string", ignore_case=True)
    return sort_with_positions(rows, spec).select("pos", F.col("value").alias("p_name"), F.col("_rid.row").alias("p_partkey"))


def sort_key_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name", "c_custkey"], "c_custkey")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0, 1), key_dir=("asc", "desc"))
    return sort_with_positions(rows, spec).select("pos", _part(0).alias("c_mktsegment"), _part(1).alias("c_name"))


def _sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an empty status where the key is divisible by 7."""
    orders_ = table(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")))
    return _csv(orders_, ["k", "o_orderkey"], "o_orderkey")


def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), nulls="last")
    return sort_with_positions(_sparse_orders(spark, sf_dir), spec).select("pos", _part(0).alias("k"), F.col("_rid.row").alias("o_orderkey"))


def sort_nulls_last_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), nulls="last", reverse=True)
    return sort_with_positions(_sparse_orders(spark, sf_dir), spec).select("pos", _part(0).alias("k"), F.col("_rid.row").alias("o_orderkey"))


def sort_numeric_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_partkey", "l_orderkey", "l_linenumber"], "n")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric")
    return sort_with_positions(rows, spec).select("pos", F.col("value").alias("record"))


def sort_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "events"), F.col("props"), F.col("event_id"))
    spec = SortSpec(input="-", output="-", format="jsonl", key_field="k", key_type="numeric")
    return sort_with_positions(rows, spec).select("pos", F.col("_k0").cast("long").alias("k"), F.col("_rid.row").alias("event_id"))


def unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows = _records(lines, F.concat_ws(",", "l_returnflag", "l_linestatus"), F.col("l_orderkey"))
    return dedup.unique(rows, SortSpec(input="-", output="-", format="string", unique=True)).select(F.col("value").alias("record"))


def unique_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sorted by user: a record goes if the one before it, by the sort, is equal."""
    rows = _csv(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric", unique=True)
    return dedup.unique(rows, spec).select(F.col("_rid.row").alias("event_id"), F.col("value").alias("record"))


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], "o_orderkey")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric", dedupe_by=(1,))
    return dedup.dedupe_first(rows, spec).select(_part(1).cast("long").alias("o_custkey"), _part(0).cast("long").alias("o_orderkey"))


def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], "o_orderkey")
    spec = SortSpec(input="-", output="-", format="csv", keys=(1,), key_type="numeric", dedupe_by=(1,), dedupe_keep="last")
    return dedup.dedupe_last(rows, spec).select(_part(1).cast("long").alias("o_custkey"), _part(0).cast("long").alias("o_orderkey"))


def dedupe_keep_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "events"), ["event_id", "event_type"], "event_id")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric", dedupe_by=(1,), dedupe_keep="last")
    return dedup.dedupe_last(rows, spec).select(_part(0).cast("long").alias("event_id"), _part(1).alias("event_type"))


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred records with the greatest price, kept in cents so that keys are whole numbers."""
    priced = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    rows = _csv(priced, ["cents", "o_orderkey"], "o_orderkey")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric", reverse=True)
    return limit.top(rows, spec, 100).select(_part(0).cast("long").alias("cents"), _part(1).cast("long").alias("o_orderkey"))


def preview_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_custkey"))
    _, shown = limit.preview(rows, SortSpec(input="-", format="string", preview=20), 20)
    return shown.select("side", "pos", F.col("value").alias("c_name"))


def merge_presorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    halves = [_records(rows.filter(F.col("o_orderkey") % 2 == i), F.col("o_orderpriority"), F.col("o_orderkey")) for i in (0, 1)]
    spec = SortSpec(output="-", format="string", merge=("a", "b"))
    found = sort_with_positions(merge.union_inputs(halves), spec)
    return found.select("pos", F.col("value").alias("o_orderpriority"), F.col("_rid.rid.row").alias("o_orderkey"))


def merge_unsorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order status, how many orders by key stand before a greater price."""
    spec = SortSpec(output="-", format="csv", keys=(0,), key_type="numeric", merge=("a",))
    found = None
    for status in ("F", "O", "P"):
        own = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
        rows = positioned(with_keys(_csv(own, ["cents", "o_orderkey"], "o_orderkey"), spec), [F.col("_rid").asc()], "merge-check")
        counted = violations(rows, spec).agg(F.count("*").alias("out_of_order")).select(F.lit(status).alias("o_orderstatus"), "out_of_order")
        found = counted if found is None else found.unionByName(counted)
    return found


def split_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_custkey"))
    placed = sort_with_positions(rows, SortSpec(input="-", output="-", format="string"))
    return split.split_by_number(placed, 4).select("pos", F.col("part").cast("long").alias("part"), F.col("value").alias("c_name"))


def split_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_custkey"))
    placed = sort_with_positions(rows, SortSpec(input="-", output="-", format="string"))
    return split.split_by_size(placed, 4096).select("pos", F.col("part").cast("long").alias("part"), F.col("value").alias("c_name"))


def _convert(spark: SparkSession, sf_dir: str, kind: str, header: str | None) -> DataFrame:
    rows = _csv(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric", output_format=kind, delimiter=",")
    out, _ = convert(sort_with_positions(rows, spec), spec, header)
    return out.select("pos", F.col("value").alias("line"))


def convert_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convert(spark, sf_dir, "tsv", "key,name,region")


def convert_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convert(spark, sf_dir, "jsonl", "key,name,region")


def convert_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convert(spark, sf_dir, "sql", "key,name,region")


def verify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders, by key, cost less than the order before."""
    priced = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    spec = SortSpec(input="-", output="-", format="csv", keys=(0,), key_type="numeric")
    rows = positioned(with_keys(_csv(priced, ["cents"], "o_orderkey"), spec), [F.col("_rid").asc()], "verify")
    return violations(rows, spec).agg(F.count("*").alias("violations"))


def stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderkey"))
    kept = dedup.unique(rows, SortSpec(input="-", output="-", format="string", unique=True))
    counts = rows.agg(F.count("*").alias("rows_in")).crossJoin(kept.agg(F.count("*").alias("rows_out")))  # one row each
    return counts.withColumn("dupes_removed", F.col("rows_in") - F.col("rows_out"))


def check_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with another number of fields than most: the full-table form of the file check."""
    rows = _records(table(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id")).withColumn("n", F.size(F.split("value", ",")))
    counts = rows.groupBy("n").agg(F.count("*").alias("c"))
    usual = counts.agg(F.max(F.struct("c", -F.col("n"))).alias("m")).select((-F.col("m.col2")).alias("usual"))
    return rows.crossJoin(F.broadcast(usual)).agg(F.first("usual").cast("long").alias("columns"), F.count_if(F.col("n") != F.col("usual")).alias("bad_rows"))  # usual: one row


def multiline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' html written as quoted fields, cut into physical lines and put together again."""
    pages = table(spark, sf_dir, "pages")
    record = F.concat(F.col("page_id").cast("string"), F.lit(',"'), F.replace("html", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = pages.select("page_id", F.posexplode(F.split(record, "\n", -1)).alias("at", "value"))
    lines = lines.select("value", F.struct(F.lit(0).alias("file"), F.floor(F.col("page_id") / 64).alias("block"), (F.col("page_id") * 100_000 + F.col("at")).alias("row")).alias("_rid"))
    return assemble_multiline(lines).select(F.md5("value").alias("record_md5"), F.length("value").cast("long").alias("n_chars"))


def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sampler says of the region and nation tables, written in several delimiters."""
    rows = []
    for name in ("region", "nation"):
        found = table(spark, sf_dir, name).limit(100).collect()  # a sample of at most 100 rows
        for d in sample.DELIMITERS:
            rows.append((name, d, sample.detect_delimiter([d.join(str(v) for v in r) for r in found])))
    return spark.createDataFrame(rows, "table string, written string, detected string")


def watch_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of customers arrive in a folder; the stream sorts each."""
    from collatrix.streaming.watch import watch

    base = f"{shared_dir(spark).removeprefix('file://')}/collatrix/watch-{uuid.uuid4().hex}"  # a folder that executors see too
    for d in ("in", "out"):
        os.makedirs(f"{base}/{d}")
    for i in (0, 1):
        names = [r.c_name for r in table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == i).select("c_name").toLocalIterator()]
        with open(f"{base}/in/half{i}.txt", "w") as f:
            f.write("\n".join(reversed(names)))
    watch(spark, f"{base}/in", f"{base}/out", SortSpec(input="-", output="-", format="string"), f"{base}/checkpoint", existing=True).awaitTermination()
    lines = spark.read.text(f"file://{base}/out").select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("c_name"))
    return lines


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    sort_u64_asc, sort_u64_desc, sort_string, sort_ignore_case, sort_key_dir, sort_nulls_last, sort_nulls_last_reverse, sort_numeric_key, sort_json_field,
    unique_rows, unique_adjacent, dedupe_keep_first, dedupe_keep_last, dedupe_keep_last_runs, top_n, preview_head_tail, merge_presorted, merge_unsorted_check,
    split_by_n, split_by_bytes, convert_tsv, convert_jsonl, convert_sql, verify_order, stats_rows, check_columns, multiline_records, detect_delimiter, watch_sort,
)}

_SPARSE = "SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS k, o_orderkey FROM orders"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_NATION = "row_number() OVER (ORDER BY n_nationkey) AS pos"
ORACLES: dict[str, str] = {
    "sort_u64_asc": "SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, o_orderkey FROM orders",
    "sort_u64_desc": "SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS pos, o_custkey, o_orderkey FROM orders",
    "sort_string": "SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS pos, c_name FROM customer",
    "sort_ignore_case": "SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS pos, p_name, p_partkey FROM part",
    "sort_key_dir": "SELECT row_number() OVER (ORDER BY c_mktsegment ASC, c_name DESC, c_custkey) AS pos, c_mktsegment, c_name FROM customer",
    "sort_nulls_last": f"SELECT row_number() OVER (ORDER BY nullif(k, '') ASC NULLS LAST, o_orderkey) AS pos, k, o_orderkey FROM ({_SPARSE})",
    "sort_nulls_last_reverse": f"SELECT row_number() OVER (ORDER BY nullif(k, '') DESC NULLS FIRST, o_orderkey) AS pos, k, o_orderkey FROM ({_SPARSE})",
    "sort_numeric_key": "SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey * 10 + l_linenumber) AS pos, concat_ws(',', l_partkey, l_orderkey, l_linenumber) AS record FROM lineitem",
    "sort_json_field": "SELECT row_number() OVER (ORDER BY CAST(props->>'$.k' AS BIGINT), event_id) AS pos, CAST(props->>'$.k' AS BIGINT) AS k, event_id FROM events",
    "unique_rows": "SELECT DISTINCT concat_ws(',', l_returnflag, l_linestatus) AS record FROM lineitem",
    "unique_adjacent": "SELECT event_id, record FROM (SELECT event_id, concat_ws(',', user_id, event_type) AS record, lag(concat_ws(',', user_id, event_type)) OVER (ORDER BY user_id, event_id) AS before FROM events) WHERE record IS DISTINCT FROM before",
    "dedupe_keep_first": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "dedupe_keep_last": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "dedupe_keep_last_runs": "SELECT event_id, event_type FROM (SELECT event_id, event_type, lead(event_type) OVER (ORDER BY event_id) AS after FROM events) WHERE event_type IS DISTINCT FROM after",
    "top_n": f"SELECT {_CENTS} AS cents, o_orderkey FROM orders ORDER BY {_CENTS} DESC, o_orderkey LIMIT 100",
    "preview_head_tail": "SELECT CASE WHEN pos <= 20 THEN 'head' ELSE 'tail' END AS side, pos, c_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS pos, count(*) OVER () AS n FROM customer) WHERE pos <= 20 OR pos > n - 20",
    "merge_presorted": "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey % 2, o_orderkey) AS pos, o_orderpriority, o_orderkey FROM orders",
    "merge_unsorted_check": f"SELECT o_orderstatus, count(*) FILTER (WHERE cents < before) AS out_of_order FROM (SELECT o_orderstatus, {_CENTS} AS cents, lag({_CENTS}) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS before FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')) GROUP BY o_orderstatus",
    "split_by_n": "SELECT pos, (pos - 1) // ((n + 3) // 4) + 1 AS part, c_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS pos, count(*) OVER () AS n FROM customer)",
    "convert_tsv": f"SELECT {_NATION}, concat_ws(chr(9), n_nationkey, n_name, n_regionkey) AS line FROM nation",
    "convert_jsonl": f"""SELECT {_NATION}, '{{"key":"' || n_nationkey || '","name":"' || n_name || '","region":"' || n_regionkey || '"}}' AS line FROM nation""",
    "convert_sql": f"""SELECT {_NATION}, 'INSERT INTO "data" ("key","name","region") VALUES (''' || n_nationkey || ''',''' || n_name || ''',''' || n_regionkey || ''');' AS line FROM nation""",
    "verify_order": f"SELECT count(*) AS violations FROM (SELECT {_CENTS} AS cents, lag({_CENTS}) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE cents < before",
    "stats_rows": "SELECT count(*) AS rows_in, count(DISTINCT o_orderpriority) AS rows_out, count(*) - count(DISTINCT o_orderpriority) AS dupes_removed FROM orders",
    "check_columns": "WITH r AS (SELECT len(string_split(text, ',')) AS n FROM documents), m AS (SELECT n FROM r GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT (SELECT n FROM m) AS columns, count(*) FILTER (WHERE n <> (SELECT n FROM m)) AS bad_rows FROM r",
    "split_by_bytes": """
WITH RECURSIVE c AS (SELECT c_name, pos, CAST(sum(strlen(c_name) + 1) OVER (ORDER BY pos) AS BIGINT) AS upto, strlen(c_name) + 1 AS size FROM (SELECT c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS pos FROM customer)),
w(part, first, base) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT part + 1, pos, upto - size FROM (SELECT w.part, c.pos, c.upto, c.size, row_number() OVER (ORDER BY c.pos) AS k FROM w JOIN c ON c.pos > w.first AND c.upto - w.base > 4096) WHERE k = 1
)
SELECT pos, (SELECT max(part) FROM w WHERE first <= pos) AS part, c_name FROM c""",
    "detect_delimiter": "SELECT t.name AS \"table\", d.d AS written, d.d AS detected FROM (VALUES ('region'), ('nation')) AS t(name), (VALUES (','), (';'), (':'), (chr(9)), ('|')) AS d(d)",
    "watch_sort": "SELECT 'sorted-half' || c_custkey % 2 || '.txt' AS file, c_name FROM customer",
    "multiline_records": "SELECT md5(r) AS record_md5, CAST(length(r) AS BIGINT) AS n_chars FROM (SELECT page_id || ',\"' || replace(html, '\"', '\"\"') || '\"' AS r FROM pages)",
}
