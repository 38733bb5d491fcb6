"""Driftlog: Spark-native analysis and upkeep of multi-device operation logs."""
