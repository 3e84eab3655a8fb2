"""spanloom: analytics over traces, logs and metrics, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
