"""Spark-native extraction of interlinear glossed text from scanned documents."""

__version__ = "0.1.0"
