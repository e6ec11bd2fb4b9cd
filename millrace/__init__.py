"""millrace: a Spark-native engine for querying, joining, cleaning, writing and reconciling tables."""
