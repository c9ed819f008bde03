"""gridweave: a PySpark-native raster-to-vector analytics engine."""
