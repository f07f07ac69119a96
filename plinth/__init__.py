"""plinth: a PySpark-native document retrieval and corpus preparation engine."""
