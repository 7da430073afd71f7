"""tarnfold: a PySpark-native engine for indexing file collections and searching them."""

__version__ = "0.1.0"
