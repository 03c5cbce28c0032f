"""Models whose sums over rows run on Spark."""
