"""Helpers shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorframe.session import stage

__all__ = ["QUERIES", "SQL", "arrow_append", "arrow_rows", "in_fold", "query", "stage", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin where there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def in_fold(doc_id: str | Column, parts: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``held``; a null id is in no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == held, F.lit(False))


def arrow_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., dict[str, list]]) -> DataFrame:
    """Rows of ``columns`` through ``fn`` batch by batch: it takes one Python list per column and returns one per output column.

    Only the named columns reach Python. An empty table gives an empty one.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Small slices: a batch of very long texts is not held as Python strings all at once.
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = fn(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_append(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., dict[str, list]]) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``fn`` gives for ``columns``; the other columns pass Python by untouched."""
    names = [part.split()[0] for part in schema.split(",")]
    target = df.sparkSession.createDataFrame([], schema).schema
    whole = StructType(df.schema.fields + target.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = fn(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(out[n], arrow.field(n).type) for n in names], names=[*part.schema.names, *names])

    return df.mapInArrow(run, whole)


def own_names(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with all columns but ``used`` named by their place, so that no name clashes with working columns; ``toDF`` gives the names back."""
    return df.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(df.columns)))


def bounded_sample(df: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same ones however the table is split.

    Rows are counted by ranges of the hash, 256 at a time and finer where a range is too full, so that little more than ``rows`` are sorted,
    however large the table or many its tasks. ``df`` is read once for each count; rows of one hash stay together.
    """
    keys = [key] if isinstance(key, str) else key
    h = F.xxhash64(*keys)
    below, low, width = 0, -(2**63), 2**64
    while width > 1:
        width //= 256
        here = df.where((h >= low) & (h <= low + width * 256 - 1))
        # The sign bit turned makes hashes rise as unsigned numbers do.
        place = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), width.bit_length() - 1).bitwiseAND(F.lit(255))
        counts = dict(here.groupBy(place.alias("place")).count().collect())
        cut = 0
        while cut < 256 and below + counts.get(cut, 0) < rows:
            below += counts.get(cut, 0)
            cut += 1
        if cut == 256:
            return df.orderBy(h, *keys)
        low += cut * width
        if below + counts[cut] <= 2 * rows:
            break
    return df.where(h <= low + width - 1).orderBy(h, *keys).limit(rows)


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))
