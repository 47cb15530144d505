"""tessera: a PySpark-native engine for document corpora and the graphs extracted from them."""
