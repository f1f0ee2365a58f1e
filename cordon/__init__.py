"""Privacy-release analytics on Spark."""
