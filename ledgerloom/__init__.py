"""PySpark-native analytics over registered-document data."""
