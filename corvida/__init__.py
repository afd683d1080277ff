"""corvida: PySpark-native analytics over large document collections."""
