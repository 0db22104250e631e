"""Lodestone: a PySpark-native engine that turns document collections into searchable, auditable evidence."""
