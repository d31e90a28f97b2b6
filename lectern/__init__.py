"""Lectern: a PySpark-native engine for document retrieval corpora."""
