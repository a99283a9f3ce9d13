"""tarmac -- flight-delay analytics as Spark DataFrame / ML / Structured Streaming jobs."""

__version__ = "0.1.0"
