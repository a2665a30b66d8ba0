"""Body-pose sequence analytics as PySpark batch and streaming jobs."""

__version__ = "0.1.0"
