"""Shared helpers of the text operators: scratch tables and fixed character sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: White space of every word and line rule here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same set as a Java character class.
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: lineage ends at durable files. ``by`` has few
    values, each of which gets folders of its own."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same wherever a text has ASCII characters alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def hash128(c: Column, name: str = "h") -> list[Column]:
    """Two independent 64-bit hashes, so that equal pairs mean equal strings at any realistic size."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(0x5EED), c).alias(f"{name}2")]


def text_chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``size`` characters of text; a longer text stands alone."""
    for b in batches:
        lengths = np.array([len(t or "") + 64 for t in b.column(text_at).to_pylist()], dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """``schema`` and one field more; the schema itself stays as it is."""
    return StructType([*schema.fields]).add(name, DataType.fromDDL(kind))


#: A sieve has at most so many rows of so many 64-bit words, 4 MB of bits, whatever goes into it.
SIEVE_ROWS, SIEVE_WORDS = 4096, 128


def _sieve_place(h: Column) -> tuple[Column, Column, Column]:
    """Row, word and bit of a 64-bit hash."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 19), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(SIEVE_ROWS)).cast("int"), F.pmod(F.shiftright(h, 12), F.lit(SIEVE_WORDS)).cast("int"), bit


def sieve(rows: DataFrame, h: Column) -> DataFrame:
    """A Bloom filter of one hash of the values ``h``, of bounded size, to tell rows that needn't move from those that may."""
    row, word, bit = _sieve_place(h)
    words = rows.select(row.alias("sieve_row"), word.alias("w"), bit.alias("b")).groupBy("sieve_row", "w").agg(F.bit_or("b").alias("b"))
    return words.groupBy("sieve_row").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("sieve_bits"))


def sift(rows: DataFrame, h: Column, by: DataFrame, name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean ``name``: false only if ``h`` is none of the sieve's values."""
    row, word, bit = _sieve_place(h)
    met = rows.select("*", row.alias("sieve_row")).join(F.broadcast(by), "sieve_row", "left")
    hit = F.element_at("sieve_bits", word).bitwiseAND(bit) != 0
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop("sieve_row", "sieve_bits")


def salted_join(many: DataFrame, few: DataFrame, on: list[str], salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """``many`` joined with ``few``, which has each key once; a key that holds much of ``many`` spreads over ``salts`` tasks."""
    one = many.withColumn("join_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    two = few.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(two, [*on, "join_salt"], how).drop("join_salt")
