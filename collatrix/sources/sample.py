"""What the head and tail of a file tell: encoding, delimiter, header, validity, and the size of a run."""

from __future__ import annotations

import gzip
import os
import shutil
import zipfile
from statistics import mode

from collatrix.errors import PreflightError
from collatrix.functions.encoding import decode, sniff
from collatrix.functions.values import human_size
from collatrix.spec import SortSpec

HEAD_BYTES = 256 << 10
TAIL_BYTES = 64 << 10
# Delimiters by preference, and words that header cells are made of.
DELIMITERS = (",", ";", ":", "\t", "|")
HEADER_WORDS = ("id", "nama", "name", "tanggal", "date", "total", "header", "kolom", "column", "email", "kota", "city")
#: Rates of the planning estimate.
MB_PER_MINUTE, LEAST_SECONDS = 120, 2.0


def head_bytes(path: str, n: int = HEAD_BYTES) -> bytes:
    """First bytes of a file's content; compressed files are opened."""
    if path.lower().endswith(".gz"):
        with gzip.open(path) as f:
            return f.read(n)
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(path) as z, z.open(z.namelist()[0]) as f:
            return f.read(n)
    with open(path, "rb") as f:
        return f.read(n)


def sample_lines(path: str, most: int = 100, encoding: str | None = None, n: int = HEAD_BYTES) -> list[str]:
    raw = head_bytes(path, n)
    text = decode(raw, encoding or sniff(raw) or "utf-8")
    lines = text.split("\n")
    whole = lines if len(raw) < n else lines[:-1]
    return [x.removesuffix("\r") for x in whole if x.strip("\r")][:most]


def split_quoted(line: str, delimiter: str) -> list[str]:
    """Fields with quotes taken off and doubled quotes single."""
    out, piece, quoted, i = [], [], False, 0
    while i < len(line):
        ch = line[i]
        if ch == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                piece.append('"')
                i += 1
            else:
                quoted = not quoted
        elif ch == delimiter and not quoted:
            out.append("".join(piece))
            piece = []
        else:
            piece.append(ch)
        i += 1
    return [*out, "".join(piece)]


def balanced(line: str) -> bool:
    return line.count('"') % 2 == 0


def detect_delimiter(lines: list[str]) -> str:
    """The candidate by which most lines have the same number of fields, more fields being a little
    better; the earlier of equals, and the comma if none splits anything."""
    best, best_score = ",", 0
    whole = [x for x in lines if balanced(x)]
    for d in DELIMITERS:
        counts = sorted(len(split_quoted(x, d)) for x in whole)
        if not counts or (middle := counts[len(counts) // 2]) < 2:
            continue
        score = sum(c == middle for c in counts) * 100 + min(middle, 20)
        if score > best_score:
            best, best_score = d, score
    return best


def _is_number(text: str) -> bool:
    try:
        float(text.strip())
    except ValueError:
        return False
    return True


def detect_header(lines: list[str], key: int, delimiter: str, numeric: bool) -> bool:
    """By the key column alone, so that other text columns mislead nobody. For a number key: the first line
    has none there, and of the next twenty three or more have one and none has anything else. For a
    text key: the first line's cell holds a word that headers use."""
    cells = [f[key].strip() if len(f) > key else "" for f in (split_quoted(x.strip(), delimiter) if delimiter else [x] for x in lines[:21])]
    if len(cells) < 2 or not cells[0]:
        return False
    if numeric:
        rest = [c for c in cells[1:] if c]
        return not _is_number(cells[0]) and len(rest) >= 3 and all(map(_is_number, rest))
    return any(w in cells[0].lower() for w in HEADER_WORDS)


def resolve(spec: SortSpec) -> SortSpec:
    """``spec`` with encoding, delimiter and header found out where they weren't given."""
    if spec.format == "numeric" or spec.input is None:
        return spec
    changes: dict = {}
    if spec.encoding_in is None and spec.format != "excel":
        changes["encoding_in"] = sniff(head_bytes(spec.input, 4)) or "utf-8"
    if spec.format == "csv":
        lines = sample_lines(spec.input, encoding=changes.get("encoding_in", spec.encoding_in))
        if spec.delimiter is None:
            changes["delimiter"] = detect_delimiter(lines)
        if spec.header is None:
            changes["header"] = detect_header(lines, spec.keys[0], changes.get("delimiter", spec.delimiter), spec.key_type == "numeric")
    elif spec.format == "excel":
        changes |= {"delimiter": ","} | ({"header": False} if spec.header is None else {})
    return spec.with_(**changes) if changes else spec


def check(path: str, spec: SortSpec) -> dict:
    """A report on the head (up to 1000 lines) and the tail of a file, ``ready`` or not. Keys must be what
    the sort will take: unsigned whole numbers, where keys are numbers."""
    size = os.path.getsize(path)
    report = {"file": path, "size_bytes": size, "est_rows": 0, "delimiter": "", "header": "no", "columns": 0, "bad_rows": 0, "encoding": "utf-8", "key": "ok", "status": "ready"}
    if spec.format == "numeric":
        wrong = size % 8
        return report | {"est_rows": size // 8, "encoding": "binary", "key": "bad" if wrong else "ok", "status": "not ready" if wrong else "ready"}
    encoding = spec.encoding_in or sniff(head_bytes(path, 4)) or "utf-8"
    lines = sample_lines(path, 1000, encoding)
    average = sum(len(x.encode()) + 1 for x in lines[:200]) / max(1, len(lines[:200]))
    report |= {"encoding": encoding, "est_rows": round(size / average) if lines else 0}
    if not spec.delimited:
        return report
    delimiter = spec.delimiter or detect_delimiter(lines[:100])
    header = spec.header if spec.header is not None else detect_header(lines, spec.keys[0], delimiter, spec.key_type == "numeric")
    tail = []
    if size > HEAD_BYTES and not path.lower().endswith((".gz", ".zip", ".xlsx")):
        with open(path, "rb") as f:
            f.seek(size - TAIL_BYTES)
            tail = [x.removesuffix("\r") for x in decode(f.read(), encoding).split("\n")[1:] if x.strip("\r")]
    rows = [x for x in [*lines[1 if header else 0 :], *tail] if balanced(x)]
    counts = [len(x.split(delimiter)) for x in rows]
    columns = mode(counts) if counts else 0
    bad = sum(c != columns for c in counts)
    fields = [x.split(delimiter) for x in rows[:500]]
    key = "ok"
    if any(k >= columns for k in spec.keys) and rows:
        key = "missing column"
    elif spec.key_type == "numeric" and any(not f[k].strip().removeprefix("+").isdigit() for f in fields for k in spec.keys if len(f) > k):
        key = "not numeric"
    ready = key == "ok" and (bad * 100 // max(1, len(counts))) < 5
    return report | {"delimiter": delimiter, "header": "yes" if header else "no", "columns": columns, "bad_rows": bad, "key": key, "status": "ready" if ready else "not ready"}


def inspect(path: str) -> dict:
    """Format, delimiter, header and column names, for whoever sets up a run."""
    low = path.lower()
    if low.endswith(".bin"):
        return {"format": "numeric", "delimiter": "", "header": False, "columns": []}
    if low.endswith(".xlsx"):
        return {"format": "excel", "delimiter": ",", "header": True, "columns": []}
    lines = sample_lines(path)
    if lines and lines[0].lstrip().startswith("{"):
        return {"format": "jsonl", "delimiter": "", "header": False, "columns": []}
    delimiter = detect_delimiter(lines)
    first = split_quoted(lines[0], delimiter) if lines else []
    if len(first) < 2:
        return {"format": "string", "delimiter": "", "header": False, "columns": []}
    header = detect_header(lines, 0, delimiter, False) or detect_header(lines, 0, delimiter, True)
    names = first if header else [f"col{i}" for i in range(len(first))]
    return {"format": "csv", "delimiter": delimiter, "header": header, "columns": names, "example": lines[1 if header and len(lines) > 1 else 0]}


def estimate(path: str, spec: SortSpec, split_bytes: int = 128 << 20, threads: int = 8, temp: str | None = None) -> dict:
    """What a run would take: rows, input splits, temporary bytes and seconds. A plan, not a promise."""
    size = os.path.getsize(path)
    if spec.format == "numeric":
        rows = size // 8
    else:
        lines = sample_lines(path, 200, spec.encoding_in)
        rows = round(size / max(1e-9, sum(len(x.encode()) + 1 for x in lines) / max(1, len(lines)))) if lines else 0
    temporary = round(size * 2.15)
    free = shutil.disk_usage(temp or ".").free
    return {
        "input": path, "size_bytes": size, "size": human_size(size), "est_rows": rows, "splits": max(1, -(-size // split_bytes)), "temp_bytes": temporary,
        "seconds": max(LEAST_SECONDS, size / (1 << 20) / MB_PER_MINUTE * 60 / threads**0.5), "temp_free_bytes": free, "temp_ok": free >= temporary,
    }


def preflight(path: str, folders: list[str]) -> None:
    """Raise if a folder on this machine lacks room for twice the input and some. Only local masters need
    this; on a cluster the shared store has its own quotas."""
    need = round(os.path.getsize(path) * 2.15)
    for folder in folders:
        free = shutil.disk_usage(folder).free
        if free < need:
            raise PreflightError(f"{folder}: {human_size(free)} free, {human_size(need)} needed")


def file_preview(path: str, n: int = 20) -> dict:
    """First and last lines of the first 64 KB, which may overlap."""
    n = max(1, min(100, n))
    lines = sample_lines(path, 1 << 30, n=64 << 10)
    return {"head": lines[:n], "tail": lines[-n:]}
