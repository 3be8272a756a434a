"""A Spark-native engine for cataloguing, searching and analysing text collections."""
