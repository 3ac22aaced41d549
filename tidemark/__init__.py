"""tidemark: time-series feature computation as ordinary Spark plans."""

__version__ = "0.1.0"
