"""A Spark-native engine that prepares and samples large static graphs."""
