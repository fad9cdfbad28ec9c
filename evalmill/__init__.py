"""A Spark-first engine for evaluating question-answering systems."""

__version__ = "0.1.0"
