"""Point-in-time equity research on PySpark DataFrames."""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
