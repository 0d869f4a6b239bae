"""Time columns: all engine times are BIGINT nanoseconds (F3-F8, F28, F31, T-support)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payloads of the printed codes that separate actions in a recording.
ACTION_CODES = {"yellow": "0I0R.119T5DY.MIXEDREALITY", "blue": "0H0R.119T5DY.MIXEDREALITY"}


def to_ns(col: Column, unit: str) -> Column:
    """source clock in ``s``, ``ms``, ``us`` or ``ns`` to whole nanoseconds (truncated)."""
    factor = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}[unit]
    return (col * F.lit(factor)).cast("bigint")


def header_ns(sec: Column, nanosec: Column, fallback: Column) -> Column:
    """message header time, or the storage time when the header has none."""
    return F.coalesce(sec.cast("bigint") * F.lit(1_000_000_000).cast("bigint") + nanosec.cast("bigint"), fallback)


def shift_imu(ts: Column, timeshift_s: Column) -> Column:
    """sensor time moved by a camera time shift in seconds."""
    return ts + (timeshift_s * F.lit(1e9)).cast("bigint")


def clock_delta(sensor_utc: Column, sensor_dev: Column, ref_utc: Column, ref_dev: Column) -> Column:
    """F8: what to add to sensor time to get reference time."""
    return (sensor_utc - sensor_dev) - (ref_utc - ref_dev)


def parse_time_payload(payload: Column, zone: str = "UTC") -> Column:
    """ns time of a clock payload ``oTyymmddHHMMSS.mmm``; null when malformed.

    The printed time is local; ``zone`` says where.
    """
    pat = r"^oT(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})\.(\d{1,3})[^.]*$"
    text = F.concat(F.lit("oT"), F.get(F.split(payload, "oT"), F.lit(1)))
    part = [F.regexp_extract(F.when(payload.startswith("oT"), text), pat, i) for i in range(1, 8)]
    num = [F.expr("try_cast(null as int)") if p is None else p.try_cast("int") for p in part]
    at = F.try_make_timestamp(num[0] + 2000, num[1], num[2], num[3], num[4], num[5].cast("decimal(8,6)"), F.lit(zone))
    return F.unix_micros(at) * F.lit(1000).cast("bigint") + num[6] * F.lit(1_000_000).cast("bigint")


def is_action_code(payload: Column) -> Column:
    """payload is one of the known action codes."""
    return payload.isin(*ACTION_CODES.values())


def linspace(start: Column, end: Column, n: int) -> Column:
    """array of ``n`` evenly spaced whole times from ``start`` to ``end``."""
    if n == 1:
        return F.array(start)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: start + ((end - start) * i / F.lit(float(n - 1))).cast("bigint"),
    )


def ordered_window(start: Column, end: Column) -> tuple[Column, Column]:
    """window with its ends in order."""
    return F.least(start, end), F.greatest(start, end)


def event_time(ts: Column) -> Column:
    """Microsecond timestamp for watermarks; keep the ns column beside it."""
    return F.timestamp_micros(F.call_function("div", ts, F.lit(1000).cast("bigint")))
