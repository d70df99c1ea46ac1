"""graphvec: a PySpark-native engine for vector-attributed property graphs."""
