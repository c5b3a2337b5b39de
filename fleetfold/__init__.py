"""Spark-native operators for fleets of low-cost environmental sensors."""
