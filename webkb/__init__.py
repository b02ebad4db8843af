"""webkb: a PySpark-native website-knowledge engine."""
