"""Spark-native auditing and reconciliation of document inventories."""
