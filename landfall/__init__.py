"""landfall: month-landing analytics for B2B sales ledgers on PySpark."""

__version__ = "0.1.0"
