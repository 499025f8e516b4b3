"""edumill: Spark-native analytics for survey evidence corpora."""
