"""maskwright: a Spark-native engine for document privacy and corpus processing."""
