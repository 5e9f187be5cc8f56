"""corpuslake: a PySpark-native library for document knowledge bases."""
