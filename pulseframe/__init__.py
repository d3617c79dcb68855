"""Spark-native analytics for health-risk tables."""

from pulseframe.session import get_spark, work_dir

__all__ = ["get_spark", "work_dir"]
