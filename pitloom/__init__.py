"""Point-in-time research data on Spark."""
