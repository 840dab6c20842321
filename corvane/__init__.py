"""Corvane: a Spark-native analytics engine for knowledge graphs of source code and documentation."""
