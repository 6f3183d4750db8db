"""One run's options, checked together. The order in which options are given never matters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from collatrix.errors import UsageError
from collatrix.functions.encoding import canonical
from collatrix.functions.values import parse_size

FORMATS = ("numeric", "string", "csv", "jsonl", "excel")
KEY_TYPES = ("string", "numeric", "date")
OUTPUTS = ("csv", "tsv", "jsonl", "sql")
#: One file put together on the driver, or a folder of ordered parts written by the executors.
LAYOUTS = ("file", "folder")
MOST_KEYS = 4
LEAST_MEMORY = 16 << 20
LEAST_SPLIT_BYTES = 1024


def parse_delimiter(text: str) -> str:
    """One character; ``\\t`` and ``tab`` mean the tab, ``\\s`` the space."""
    found = {"\\t": "\t", "tab": "\t", "\\s": " "}.get(text.lower() if len(text) > 1 else text, text)
    if len(found) != 1 or ord(found) > 127:
        raise UsageError(f"delimiter must be one ASCII character: {text!r}")
    return found


@dataclass(frozen=True)
class SortSpec:
    """What to read, how to order and reduce it, and what to write.

    Keys are 0-based columns. By default they are taken in ascending order of column, whatever the
    order given, and ``key_dir`` belongs to that order; ``preserve_key_order`` keeps the given one.
    """

    input: str | None = None
    output: str | None = None
    format: str = "numeric"
    keys: tuple[int, ...] = ()
    key_type: str = "string"
    key_field: str | None = None
    key_dir: tuple[str, ...] = ()
    preserve_key_order: bool = False
    delimiter: str | None = None
    header: bool | None = None
    quoted_keys: bool = False
    reverse: bool = False
    ignore_case: bool = False
    nulls: str = "first"
    unique: bool = False
    distinct: bool = False
    dedupe_by: tuple[int, ...] = ()
    dedupe_keep: str = "first"
    limit: int | None = None
    preview: int | None = None
    verify: bool = False
    merge: tuple[str, ...] = ()
    output_format: str | None = None
    sql_table: str = "data"
    encoding_in: str | None = None
    encoding_out: str | None = None
    sheet: str | None = None
    split_by: int | None = None
    split_by_size: str | int | None = None
    force: bool = False
    backup: bool = False
    log_file: str | None = None
    resume: bool = False
    max_memory: str | int | None = None
    threads: int | None = None
    output_layout: str | None = None
    split_bytes: int | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("keys", "dedupe_by"):
            columns = tuple(getattr(self, name))
            if any(not isinstance(c, int) or c < 0 for c in columns):
                raise UsageError(f"{name}: columns are whole numbers from 0")
            kept = tuple(dict.fromkeys(columns))
            put(name, kept if name == "keys" and self.preserve_key_order else tuple(sorted(kept)))
        if self.delimiter is not None:
            put("delimiter", parse_delimiter(self.delimiter))
        for name in ("encoding_in", "encoding_out"):
            if getattr(self, name) is not None:
                put(name, canonical(getattr(self, name)))
        if self.split_by_size is not None:
            put("split_bytes", parse_size(self.split_by_size))
        if self.max_memory is not None:
            put("max_memory", parse_size(self.max_memory))
        self._check()

    def _check(self) -> None:
        def refuse(wrong: bool, why: str) -> None:
            if wrong:
                raise UsageError(why)

        delimited = self.format in ("csv", "excel")
        refuse(self.format not in FORMATS, f"format is one of {', '.join(FORMATS)}")
        refuse(self.key_type not in KEY_TYPES, f"key type is one of {', '.join(KEY_TYPES)}")
        refuse(self.nulls not in ("first", "last"), "nulls is first or last")
        refuse(self.dedupe_keep not in ("first", "last"), "dedupe-keep is first or last")
        refuse(bool(self.keys) and not delimited, "key columns need csv or excel")
        refuse(delimited and not self.keys, "csv and excel need key columns")
        refuse(len(self.keys) > MOST_KEYS, f"at most {MOST_KEYS} key columns")
        refuse((self.format == "jsonl") != bool(self.key_field), "jsonl needs a key field, and only jsonl has one")
        refuse(self.key_type != "string" and self.format in ("numeric", "string"), "a key type needs csv, excel or jsonl")
        refuse(any(d not in ("asc", "desc") for d in self.key_dir), "key directions are asc or desc")
        refuse(bool(self.key_dir) and not delimited, "key directions need csv or excel")
        refuse(bool(self.key_dir) and len(self.key_dir) != len(self.keys), "one direction for each key")
        refuse(bool(self.dedupe_by) and not delimited, "dedupe-by needs csv or excel")
        refuse(bool(self.header) and self.format in ("numeric", "jsonl"), "numeric and jsonl have no header")
        for name, least in (("limit", 1), ("preview", 1), ("split_by", 2)):
            value = getattr(self, name)
            refuse(value is not None and value < least, f"{name} is at least {least}")
        refuse(self.split_bytes is not None and self.split_bytes < LEAST_SPLIT_BYTES, "split-by-size is at least 1 KB")
        splits = self.split_by is not None or self.split_bytes is not None
        refuse(self.split_by is not None and self.split_bytes is not None, "split by number or by size, not both")
        refuse(splits and self.preview is not None, "a preview isn't split")
        refuse(bool(self.merge) and (self.input is not None or self.resume or self.preview is not None), "merge has its own inputs and neither resume nor preview")
        refuse(bool(self.merge) and self.output is None, "merge needs an output")
        refuse(bool(self.merge) and any(p.lower().endswith((".gz", ".zip", ".xlsx")) for p in self.merge), "merge reads plain files")
        refuse(self.output_format is not None and self.output_format not in OUTPUTS, f"output format is one of {', '.join(OUTPUTS)}")
        refuse(self.output_format is not None and not delimited, "conversion needs csv or excel input")
        refuse(self.max_memory is not None and self.max_memory < LEAST_MEMORY, "max-memory is at least 16 MB")
        refuse(self.threads is not None and self.threads < 1, "threads is at least 1")
        refuse(self.output_layout not in (None, *LAYOUTS), f"output layout is one of {', '.join(LAYOUTS)}")
        refuse(self.output_layout == "folder" and splits, "a folder isn't split: it has parts of its own")
        target = (self.output or "").lower()
        refuse(self.output_layout == "folder" and target.endswith((".xlsx", ".zip")), "a folder holds text parts")
        refuse(target.endswith(".xlsx") and not delimited, "xlsx output needs csv or excel")
        refuse(target.endswith(".xlsx") and (self.encoding_out is not None or self.output_format is not None), "xlsx output has no encoding or conversion")
        refuse(target.endswith((".xlsx", ".gz", ".zip")) and splits, "xlsx, gz and zip outputs aren't split")
        refuse(any((p or "").lower().endswith((".zst", ".zstd")) for p in (self.input, self.output, *self.merge)), "zstd files aren't supported")

    @property
    def delimited(self) -> bool:
        return self.format in ("csv", "excel")

    def with_(self, **changes) -> SortSpec:
        changes.setdefault("split_by_size", self.split_by_size)
        return replace(self, **changes)
