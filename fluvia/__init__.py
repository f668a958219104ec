"""fluvia: Spark-native daily environmental time-series analytics."""
