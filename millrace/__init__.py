"""Log routing and batching on Spark."""
