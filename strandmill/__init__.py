"""Read quality control on Spark."""
