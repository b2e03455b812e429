"""A PySpark-native engine for documents, text and the tables derived from them."""
