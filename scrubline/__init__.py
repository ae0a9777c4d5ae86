"""scrubline: a Spark-native engine that sanitizes tables of text."""
