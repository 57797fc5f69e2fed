"""kinfold: find, score, group and resolve duplicate records, files and documents with Spark."""

__version__ = "0.1.0"
