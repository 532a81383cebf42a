"""A Spark-native catalogue engine for ebook collections."""
