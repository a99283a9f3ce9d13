"""Spark ML plans: feature stages, models, tuning and the end-to-end jobs."""
