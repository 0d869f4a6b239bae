"""Query registry and the mapping of the given tables to sensor tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.ordered import DAY_NS, Series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MIN_NS = 60_000_000_000
HOUR_NS = 60 * MIN_NS


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Event times carry no zone; reading them as UTC keeps them equal to the SQL side.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ns(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp")) * F.lit(1000).cast("bigint")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as sensor samples: ns time, topic, recorder, value."""
    return table(spark, sf, "events").select(
        "event_id", ns("ts").alias("ts"), F.col("event_type").alias("topic"), F.col("user_id").alias("recorder"), "value"
    )


def topic(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return samples(spark, sf).where(F.col("topic") == name)


# The same mapping for the SQL side.
SAMPLES = (
    "samples AS (SELECT event_id, epoch_us(ts)*1000 AS ts, event_type AS topic, user_id AS recorder, value FROM events)"
)
# One rig: all samples of a topic as one series.
RIG = Series(["rig"], cell_ns=DAY_NS)
# One series per recorder.
REC = Series(["recorder"], cell_ns=30 * DAY_NS)


def rig(df: DataFrame) -> DataFrame:
    return df.withColumn("rig", F.lit(0))


def r6(col, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)
