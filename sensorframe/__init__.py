"""Spark-native analytics over multi-sensor recordings."""

from sensorframe.session import get_spark

__all__ = ["get_spark"]
