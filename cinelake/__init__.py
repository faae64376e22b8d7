"""A PySpark-native engine for media catalogues and release schedules."""
