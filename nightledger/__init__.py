"""Telemetry archive and exposure metadata as PySpark DataFrame jobs."""
