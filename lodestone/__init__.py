"""A PySpark-native engine for document ingest, retrieval and catalogue analytics."""
