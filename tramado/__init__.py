"""tramado: linking dated documents into threads, and measuring how far those threads can be trusted, on Spark."""

__version__ = "0.1.0"
