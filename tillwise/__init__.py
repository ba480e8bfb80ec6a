"""Cash-flow analytics for point-of-sale data, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
