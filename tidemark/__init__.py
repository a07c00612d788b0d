"""Tidemark: a PySpark-native engine for append-only, nanosecond-keyed event records."""
