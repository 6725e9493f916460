"""Evidence weighing on Spark."""
