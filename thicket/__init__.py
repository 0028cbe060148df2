"""thicket: structural code search, rule scanning and table operators on Spark."""

__version__ = "0.1.0"
