"""A PySpark-native engine for time-series scoring, base rates and scenarios."""
