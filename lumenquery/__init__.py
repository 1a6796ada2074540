"""lumenquery: relational, spatial, text, vector and sequence analytics written for Spark."""

__version__ = "0.1.0"
