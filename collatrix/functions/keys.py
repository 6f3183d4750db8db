"""Sort keys and orders as Spark columns, with bad data raised rather than turned into null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collatrix.errors import DATA_MARK
from collatrix.spec import SortSpec

MOST_U64 = "18446744073709551615"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A noncharacter that marks cuts; where a record holds it, it is escaped.
_ESCAPE, _CUT, _HELD = "\uFFFE", "\uFFF9", "\uFFFA"
_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def bad(why: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{DATA_MARK}{why}: "), F.coalesce(F.substring(value, 1, 80), F.lit("null"))))


def fields(value: Column, delimiter: str, quoted: bool = False) -> Column:
    """Parts of a record: split at every delimiter, or with ``quoted`` only outside quotes, which are taken
    off, doubled ones being one. Both are linear in the record and have no recursion."""
    if not quoted:
        return F.split(value, "\\Q" + delimiter + "\\E", -1)
    held = F.replace(value, F.lit(_ESCAPE), F.lit(_ESCAPE + _HELD))
    parts = F.split(_quote_parts(held, delimiter, _ESCAPE + _CUT, unquote=True), _ESCAPE + _CUT, -1)
    return F.transform(parts, lambda x: F.replace(x, F.lit(_ESCAPE + _HELD), F.lit(_ESCAPE)))


def _quote_parts(value: Column, delimiter: str, new: str, unquote: bool) -> Column:
    """``value`` with ``new`` for each delimiter outside quotes. What stands between quotes has an odd
    number among the parts around them; an empty part between two quoted ones is a doubled quote."""
    outside = lambda x: F.replace(x, F.lit(delimiter), F.lit(new))
    if not unquote:
        each = lambda p: F.transform(p, lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x))
    else:
        doubled = lambda p, x, i: (x == "") & (i > 0) & (i < F.size(p) - 1)
        each = lambda p: F.transform(p, lambda x, i: F.when(i % 2 == 1, x).when(doubled(p, x, i), F.lit('"')).otherwise(outside(x)))
    whole = F.transform(F.array(F.split(value, '"', -1)), lambda p: F.array_join(each(p), "" if unquote else '"'))
    return F.get(whole, F.lit(0))


def redelimit(value: Column, delimiter: str, new: str) -> Column:
    """The record with another delimiter; quotes and all else stay."""
    return value if delimiter == new else _quote_parts(value, delimiter, new, unquote=False)


def unsigned(text: Column, record: Column, why: str) -> Column:
    """``decimal(20,0)`` of digits with an optional plus sign, 0 to 2**64 - 1; anything else raises."""
    plain = F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("decimal(20,0)"))  # most keys; no rewriting
    trimmed = F.regexp_replace(text, _BLANK, "")
    number = F.when(trimmed.rlike(r"^[+]?[0-9]+$"), F.regexp_replace(trimmed, r"^[+]?0*(?=[0-9])", "").try_cast("decimal(20,0)"))
    checked = F.when(number <= F.lit(MOST_U64).cast("decimal(20,0)"), number).otherwise(bad(why, record).cast("decimal(20,0)"))
    return F.coalesce(plain, checked)


def csv_key(value: Column, parts: Column, column: int, spec: SortSpec) -> Column:
    field = F.when(F.size(parts) > column, F.get(parts, F.lit(column))).otherwise(bad(f"no column {column}", value))
    if spec.key_type == "numeric":
        return unsigned(field, value, f"column {column} isn't an unsigned number")
    return F.lower(field) if spec.ignore_case else field


def json_field(value: Column, path: str) -> Column:
    """The variant at a dotted path of object keys; null if it is missing or the JSON is invalid."""
    steps = "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(value), steps, "variant")


def json_key(value: Column, found: Column, path: str, spec: SortSpec) -> Column:
    """The scalar of a JSON field. Missing or invalid raises; JSON null is empty text; arrays and objects
    are their canonical JSON text."""
    held = F.when(found.isNotNull(), found).otherwise(F.parse_json(F.when(F.lit(True), bad(f"no field {path}", value)).cast("string")))
    kind = F.schema_of_variant(held)
    text = F.when(F.is_variant_null(held), F.lit("")).otherwise(F.coalesce(F.try_variant_get(held, "$", "string"), F.to_json(held)))
    if spec.key_type == "numeric":
        usable = kind.isin("BIGINT", "STRING") | kind.startswith("DECIMAL")
        return unsigned(F.when(usable, text), value, f"field {path} isn't an unsigned number")
    return F.lower(text) if spec.ignore_case else text


def parsed_record(spec: SortSpec) -> Column | None:
    """What the keys of a record are taken from, to be computed once: its fields, or its JSON field."""
    if spec.delimited:
        return fields(F.col("value"), spec.delimiter or ",", spec.quoted_keys)
    return json_field(F.col("value"), spec.key_field) if spec.format == "jsonl" else None


def key_columns(spec: SortSpec) -> dict[str, Column]:
    """Columns _k0.. of a framed record table (value string, or value binary for numeric), with the
    column ``_parsed`` of ``parsed_record`` where there is one."""
    value, parsed = F.col("value"), F.col("_parsed")
    if spec.delimited:
        return {f"_k{i}": csv_key(value, parsed, c, spec) for i, c in enumerate(spec.keys)}
    if spec.format == "jsonl":
        return {"_k0": json_key(value, parsed, spec.key_field, spec)}
    return {"_k0": F.lower(value) if spec.ignore_case and spec.format == "string" else value}


def orders(spec: SortSpec) -> list[Column]:
    """Sort orders of the keys, then of the input order, which is never reversed.

    A key descends if its direction or the whole run is reversed, but not both. Empty text is the
    null key; its place is turned around with the key: nulls end up last if "last" was asked for or
    the key descends, but not both.
    """
    out = []
    for i in range(max(1, len(spec.keys))):
        down = (bool(spec.key_dir) and spec.key_dir[i] == "desc") != spec.reverse
        key = F.col(f"_k{i}")
        if spec.format in ("numeric", "string") or spec.key_type == "numeric":
            out.append(key.desc() if down else key.asc())
            continue
        key, last = F.nullif(key, F.lit("")), (spec.nulls == "last") != down
        out.append((key.desc_nulls_last() if last else key.desc_nulls_first()) if down else (key.asc_nulls_last() if last else key.asc_nulls_first()))
    return [*out, F.col("_rid").asc()]


def dedupe_key(spec: SortSpec) -> Column:
    """The dedupe columns of a record, joined by 0x1f; missing columns count as empty."""
    parts = fields(F.col("value"), spec.delimiter or ",", spec.quoted_keys)
    held = [F.coalesce(F.get(parts, F.lit(c)), F.lit("")) for c in spec.dedupe_by]
    joined = F.concat_ws("\x1f", *held)
    return F.lower(joined) if spec.ignore_case else joined


def record_key(spec: SortSpec) -> Column:
    """What makes records equal for ``unique``: the record, letters A-Z folded if case is ignored."""
    value = F.col("value")
    return F.translate(value, UPPER, UPPER.lower()) if spec.ignore_case and spec.format != "numeric" else value


def u64_text(be: Column) -> Column:
    """Decimal of 8 bytes, most significant first."""
    return F.conv(F.hex(be), 16, 10).cast("decimal(20,0)")
