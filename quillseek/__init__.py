"""Filter, aggregate and sort Spark DataFrames with compact text expressions."""

__version__ = "0.1.0"
