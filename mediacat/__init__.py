"""A PySpark-native analytics engine for media catalogs."""
