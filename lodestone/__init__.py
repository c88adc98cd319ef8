"""Lodestone: a PySpark-native engine for document-style datasets."""
