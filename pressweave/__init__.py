"""News clustering and feed analytics on Spark."""
