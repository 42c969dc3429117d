"""marksmith: Spark-native analytics for examination assessment data."""
