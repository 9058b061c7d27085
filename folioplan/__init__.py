"""A Spark-first engine for scholarly libraries, citation graphs and the text around them."""

__version__ = "0.1.0"
