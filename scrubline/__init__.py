"""Data quality and cleaning on Spark."""
