"""Scholia: a PySpark-native engine for scholarly-literature and note-card collections."""
