"""Spindrift: a PySpark-native analytics engine for multi-channel event data."""
