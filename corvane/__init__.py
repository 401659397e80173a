"""A PySpark-native engine for retrieval analytics over hierarchical documents."""
