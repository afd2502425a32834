"""quire: a PySpark-native document index and hybrid retrieval engine."""
