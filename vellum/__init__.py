"""A Spark-native engine for searching and analysing a library of documents."""
