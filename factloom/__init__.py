"""factloom: code-intelligence analytics over relational source facts, on Spark."""

__version__ = "0.1.0"
