"""Time-series features, evaluation and forecasting as PySpark jobs."""

from tidegrid.timeline import Timeline

__all__ = ["Timeline"]
