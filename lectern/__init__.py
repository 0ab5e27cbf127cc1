"""Library analytics over reading collections, written for Spark."""
