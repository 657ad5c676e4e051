"""Text analytics over large document collections, on PySpark."""
