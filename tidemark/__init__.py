"""tidemark: daily time-series features and data-quality checks as Spark DataFrame operators."""

__version__ = "0.1.0"
