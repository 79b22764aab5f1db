"""Timeline-moment analytics on Spark: many timelines, one job per question."""

__version__ = "0.1.0"
