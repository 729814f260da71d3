"""Analytics operators for change-driven table pipelines on Spark."""
