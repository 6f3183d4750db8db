"""Made inputs: numbers, lines or delimited records, the same for the same seed on any cluster."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.errors import UsageError

# The cities and the header of made delimited records.
CITIES = ("Jakarta", "Bandung", "Surabaya", "Medan", "Depok", "Bogor", "Tangerang", "Bekasi")
CSV_HEADER = "id,idx,city,name"
MOST_DEMO_ROWS = 1_000_000
# Fixed values of the stream that fixtures are drawn from: word, multiplier and default seed.
MASK, MULTIPLIER, SEED = (1 << 64) - 1, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15


def _draw(seed: int, salt: int) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed or 1), F.lit(salt))


def _letters(seed: int, salt: int, least: int = 1, most: int = 31) -> Column:
    """``least`` to ``most`` letters a-z."""
    length = F.pmod(_draw(seed, salt), F.lit(most - least + 1)) + least
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed or 1), F.lit(salt), i), F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), letter), "")


def generate(spark: SparkSession, rows: int, kind: str, seed: int = 1) -> DataFrame:
    """``value`` and ``_rid`` of so many records; ``kind`` is numeric, string or csv. Values depend on the
    seed and the row alone, so partitions are made in parallel."""
    ids = spark.range(rows)
    if kind == "numeric":
        value = F.unhex(F.lpad(F.hex(_draw(seed, 0)), 16, "0"))
    elif kind == "string":
        value = _letters(seed, 1)
    elif kind == "csv":
        number = F.conv(F.hex(_draw(seed, 0)), 16, 10)
        city = F.get(F.array(*[F.lit(c) for c in CITIES]), F.pmod(_draw(seed, 2), F.lit(len(CITIES))).cast("int"))
        value = F.concat_ws(",", number, F.col("id").cast("string"), city, _letters(seed, 3, 2, 12))
    else:
        raise UsageError("kind is numeric, string or csv")
    zero = F.lit(0)
    return ids.select(value.alias("value"), F.struct(zero.alias("file"), zero.cast("long").alias("block"), F.col("id").alias("row")).alias("_rid"))


def xorshift(seed: int) -> Iterator[int]:
    """The public xorshift64* stream; seed 0 counts as 1."""
    x = seed or 1
    while True:
        x ^= x >> 12
        x = (x ^ x << 25) & MASK
        x ^= x >> 27
        yield x * MULTIPLIER & MASK


def write_fixture(path: str, rows: int, kind: str, seed: int = SEED, header: bool = False) -> None:
    """A file of records drawn one after another from one stream, on the driver: for fixtures, whose
    values must be the same as those of other tools with the same seed. ``generate`` is for large inputs."""
    if kind not in ("numeric", "string", "csv"):
        raise UsageError("kind is numeric, string or csv")
    if header and kind != "csv":
        raise UsageError("only csv has a header")
    draw = xorshift(seed)
    word = lambda n: bytes(97 + next(draw) % 26 for _ in range(n))
    with open(path, "wb") as f:
        if header:
            f.write(CSV_HEADER.encode() + b"\n")
        for i in range(rows):
            if kind == "numeric":
                f.write(next(draw).to_bytes(8, "little"))
            elif kind == "string":
                f.write(word(next(draw) % 31 + 1) + b"\n")
            else:
                number, city = next(draw), CITIES[next(draw) % len(CITIES)]
                f.write(f"{number},{i},{city},".encode() + word(next(draw) % 11 + 2) + b"\n")
