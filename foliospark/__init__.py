"""foliospark: a PySpark-native engine for document, image-placement and text analytics."""

__version__ = "0.1.0"
